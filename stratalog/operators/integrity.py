"""Consistency of a journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.retention import orphan_traces
from stratalog.sources.journal import SCHEMA_VERSION, rejection


def issues(journal: DataFrame, registry: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """(issue, n): what is wrong and how often; no rows for a sound journal.

    Traces without a source, sessions and registered sources without events, events of a newer layout, events that
    validation would refuse, and ids that occur twice.
    """
    found = [("orphan_trace", orphan_traces(journal))]
    if sessions is not None:
        found.append(("session_without_events", sessions.join(journal.select("session_id").distinct(), "session_id", "left_anti")))
    if registry is not None:
        found.append(("source_without_events", registry.join(journal.select("datasource_fingerprint").distinct(), "datasource_fingerprint", "left_anti")))
    found.append(("repeated_id", journal.groupBy("event_id").agg(F.count("*").alias("c")).where("c > 1")))
    # What one row tells is counted in one pass.
    own = journal.agg(F.count_if(F.col("event_schema_version") > SCHEMA_VERSION).alias("newer_layout"), F.count_if(rejection().isNotNull()).alias("invalid_event"))
    out = own.unpivot([], ["newer_layout", "invalid_event"], "issue", "n")
    for name, rows in found:
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n"))
    return out.where("n > 0")
