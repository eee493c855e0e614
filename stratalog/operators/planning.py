"""Plans: the compensating actions of a set of events, their order, and whether they may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import identity, moments
from stratalog.operators.rewind import Cutoff
from stratalog.sources.journal import is_trace

#: What compensates an operation, and the phase in which that runs.
COMPENSATION = {"DELETE": ("INSERT", 0), "UPDATE": ("UPDATE", 1), "INSERT": ("DELETE", 2)}
MOST_EVENTS, MOST_ENTITIES, WARN_EVENTS, WARN_ENTITIES = 10_000, 1_000, 1_000, 100


def _lookup(place: int) -> Column:
    out = F.when(F.lit(False), F.lit(COMPENSATION["INSERT"][place]))
    for operation, values in COMPENSATION.items():
        out = out.when(F.col("operation_type") == operation, F.lit(values[place]))
    return out


def judged(events: DataFrame, mode: str = "TEMPORAL") -> DataFrame:
    """Events with ``compensation``, ``phase``, ``seq``, ``conflict`` and ``blocking``.

    Traces and unknown operations block the plan. An event without an entity fingerprint gets no action in a temporal
    plan, with a warning. Order: inserts by id, updates by falling id, deletes by id.
    """
    unnamed = F.coalesce("entity_fingerprint", F.lit("")) == ""
    conflict = (
        F.when(is_trace(), "trace_event_leaked")
        .when(_lookup(0).isNull(), F.concat(F.lit("unsupported_operation: "), F.coalesce("operation_type", F.lit("null"))))
        .when(unnamed, "missing_entity_fingerprint")
    )
    out = events.withColumns({"conflict": conflict, "phase": _lookup(1)})
    blocking = F.coalesce(~F.col("conflict").isin("missing_entity_fingerprint"), F.lit(False))
    acts = F.col("conflict").isNull() | (~blocking & F.lit(mode != "TEMPORAL"))
    seq = F.when(F.col("phase") == 1, -F.col("event_id")).otherwise(F.col("event_id"))
    return out.withColumns({"blocking": blocking, "compensation": F.when(acts, _lookup(0)), "seq": seq})


def actions(events: DataFrame, mode: str = "TEMPORAL") -> DataFrame:
    """The plan: one row per action, to be run in order of ``phase`` and ``seq`` within its source."""
    rows = judged(events, mode).where("compensation IS NOT NULL")
    name = F.coalesce(F.nullif("entity_fingerprint", F.lit("")), F.concat(F.lit("eid_"), F.col("event_id").cast("string")))
    return rows.select(
        "datasource_fingerprint",
        "event_id",
        "operation_type",
        "compensation",
        name.alias("entity_fingerprint"),
        F.col("layer_name_snapshot").alias("layer_name"),
        F.col("geometry_wkb").isNotNull().alias("has_geometry"),
        "phase",
        "seq",
    )


def operation_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("datasource_fingerprint", "compensation").agg(F.count("*").alias("n_actions"))


def preflight(events: DataFrame, cutoff: Cutoff, oldest: DataFrame | None = None, horizons: DataFrame | None = None, mode: str = "TEMPORAL") -> DataFrame:
    """One row per source: n_events, n_entities, verdict (GO, GO_WITH_WARNINGS, BLOCKED), blocking and warning reasons.

    ``oldest(datasource_fingerprint, first_at)`` and ``horizons(datasource_fingerprint, purged_until)`` say what the
    journal still covers; both are a row a source.
    """
    rows = judged(events, mode)
    acts = F.col("compensation").isNotNull()
    out = rows.groupBy("datasource_fingerprint").agg(
        F.count_if(acts).alias("n_events"),
        F.countDistinct(F.when(acts, F.col("entity_fingerprint"))).alias("n_entities"),
        F.count_if("blocking").alias("n_blocking"),
        F.count_if(F.col("conflict").isNotNull() & ~F.col("blocking")).alias("n_warnings"),
    )
    value = moments.normalised_cutoff(cutoff.value) if cutoff.by == "created_at" else None
    for extra, column in ((oldest, "first_at"), (horizons, "purged_until")):
        out = out.withColumn(column, F.lit(None).cast("string")) if extra is None else out.join(extra, "datasource_fingerprint", "left")
    dated = F.lit(value).cast("string")
    blocks = [
        (F.col("n_events") > MOST_EVENTS, "too_many_events"),
        (F.col("n_entities") > MOST_ENTITIES, "too_many_entities"),
        (F.lit(cutoff.by == "created_at" and value is None), "invalid_cutoff"),
        (dated < F.col("first_at"), "history_purged"),
        (dated <= F.col("purged_until"), "behind_purge_horizon"),
        (F.col("n_blocking") > 0, "blocking_conflicts"),
        (F.col("n_events") == 0, "no_actions"),
    ]
    warns = [
        ((F.col("n_events") > WARN_EVENTS) & (F.col("n_events") <= MOST_EVENTS), "many_events"),
        ((F.col("n_entities") > WARN_ENTITIES) & (F.col("n_entities") <= MOST_ENTITIES), "many_entities"),
        (F.col("n_warnings") > 0, "skipped_events"),
    ]
    join = lambda rules: F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in rules])), ",")
    out = out.withColumns({"blocking": join(blocks), "warnings": join(warns)})
    verdict = F.when(F.col("blocking") != "", "BLOCKED").when(F.col("warnings") != "", "GO_WITH_WARNINGS").otherwise("GO")
    return out.select("datasource_fingerprint", "n_events", "n_entities", verdict.alias("verdict"), "blocking", "warnings")


def capability_gaps(plan: DataFrame, sources: DataFrame, mode: str = "TEMPORAL") -> DataFrame:
    """Sources of a plan whose provider may not be restored in this mode: datasource_fingerprint, remark."""
    modes = F.broadcast(identity.restore_modes(plan.sparkSession).where(F.col("mode") == mode))  # a few fixed rows
    used = plan.select("datasource_fingerprint").distinct().join(sources.select("datasource_fingerprint", "provider_type"), "datasource_fingerprint")
    met = used.join(modes, "provider_type", "left")
    return met.where(~F.coalesce("allowed", F.lit(False))).select("datasource_fingerprint", F.coalesce("remark", F.lit("Unknown provider")).alias("remark"))


def report(plan: DataFrame) -> DataFrame:
    """A line of text per source: its actions by kind."""
    kinds = [F.count_if(F.col("compensation") == k).alias(k) for k in ("INSERT", "UPDATE", "DELETE")]
    counts = plan.groupBy("datasource_fingerprint").agg(*kinds, F.countDistinct("entity_fingerprint").alias("entities"))
    line = F.format_string("%d inserts, %d updates, %d deletes on %d entities", "INSERT", "UPDATE", "DELETE", "entities")
    return counts.select("datasource_fingerprint", line.alias("line"))
