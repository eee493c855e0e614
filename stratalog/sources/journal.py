"""The journal: its schema, its reading, writing and migration, and the lookups on it.

A journal is an append-only table of edit events. A *trace* is an event that records that another one was compensated
(``restored_from_event_id``); a trace is active until it is invalidated. Order in time is (``created_at``, ``event_id``):
late events get late ids. ``created_at`` is ISO text in UTC and is compared as text.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import identity

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "string": T.StringType()}
_COLUMNS = """
    event_id:long project_fingerprint datasource_fingerprint layer_id_snapshot layer_name_snapshot provider_type
    feature_identity_json operation_type attributes_json geometry_wkb:binary geometry_type crs_authid field_schema_json
    user_name session_id created_at restored_from_event_id:long entity_fingerprint event_schema_version:int
    new_geometry_wkb:binary invalidated_at
"""
JOURNAL = T.StructType([T.StructField(n, _KINDS[k or "string"]) for n, _, k in (c.partition(":") for c in _COLUMNS.split())])
SCHEMA_VERSION = 6
OPERATIONS = ("INSERT", "UPDATE", "DELETE")

is_trace = lambda: F.col("restored_from_event_id").isNotNull()
is_active = lambda: F.col("invalidated_at").isNull()


def order_key(prefix: str = "") -> Column:
    """The place of an event in time."""
    return F.struct(F.col(f"{prefix}created_at").alias("created_at"), F.col(f"{prefix}event_id").alias("event_id"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal written by ``write_journal``; older layouts are migrated."""
    return migrate(spark.read.parquet(path))


#: Events that a task of ``write_journal`` writes, about.
TASK_EVENTS = 500_000


def write_journal(events: DataFrame, path: str, mode: str = "append", buckets: int = 64, ordered: bool = False, spread: int | None = None) -> None:
    """Appends events, partitioned by a bucket of their source so that reads of one source skip the others' files.

    The bucket is a hash, as fingerprints hold path characters and their number is not bounded. Rows are dealt by bucket
    and entity, so a source that holds most of the journal is still written by many tasks: one for each ``TASK_EVENTS``
    events of all, if ``spread`` doesn't say how many. ``ordered`` sorts each file by source, entity and time.
    """
    bucket = F.pmod(F.xxhash64("datasource_fingerprint"), F.lit(buckets)).cast("int")
    events = events.withColumn("source_bucket", bucket)
    tasks = spread or 1 + events.count() // TASK_EVENTS
    part = F.pmod(F.xxhash64("entity_fingerprint", "event_id"), F.lit(tasks))
    dealt = events.repartition("source_bucket", part)
    if ordered:
        dealt = dealt.sortWithinPartitions("source_bucket", "datasource_fingerprint", "entity_fingerprint", "created_at", "event_id")
    dealt.write.mode(mode).partitionBy("source_bucket").parquet(path)


def of_source(journal: DataFrame, fingerprint: str, buckets: int = 64) -> DataFrame:
    """Events of one source; prunes folders where the journal has buckets."""
    if "source_bucket" in journal.columns:
        wanted = journal.sparkSession.range(1).select(F.pmod(F.xxhash64(F.lit(fingerprint)), F.lit(buckets)).cast("int")).first()[0]
        journal = journal.where(F.col("source_bucket") == wanted)
    return journal.where(F.col("datasource_fingerprint") == fingerprint)


def migrate(events: DataFrame) -> DataFrame:
    """The current layout: missing columns become typed nulls and missing entity fingerprints are derived."""
    for field in JOURNAL.fields:
        if field.name not in events.columns:
            events = events.withColumn(field.name, F.lit(None).cast(field.dataType))
    derived = identity.entity_fingerprint("feature_identity_json")
    columns = [
        F.coalesce("entity_fingerprint", derived).alias("entity_fingerprint")
        if f.name == "entity_fingerprint"
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in JOURNAL.fields
    ]
    return events.select(*columns, *[c for c in events.columns if c == "source_bucket"])


def light(events: DataFrame) -> DataFrame:
    """All columns, but of the geometries only whether they are there: their bytes are never read."""
    blobs = {"geometry_wkb": "has_geometry", "new_geometry_wkb": "has_new_geometry"}
    return events.select(*[F.col(c).isNotNull().alias(blobs[c]) if c in blobs else F.col(c) for c in JOURNAL.names])


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def events_by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose id is in the one column of ``ids``, newest id first."""
    wanted = ids.select(F.col(ids.columns[0]).alias("event_id")).distinct()
    return events.join(wanted, "event_id", "left_semi").orderBy(F.desc("event_id"))


def rejection(required: tuple[str, ...] = ("operation_type", "attributes_json", "created_at")) -> Column:
    """Why an event may not be written; null for a valid one."""
    reasons = [F.when(~F.col("operation_type").isin(*OPERATIONS) | F.col("operation_type").isNull(), "bad operation_type")]
    reasons += [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"empty {c}") for c in required if c != "operation_type"]
    return F.coalesce(*reasons)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their ``reason``)."""
    judged = events.withColumn("reason", rejection())
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def write_pending(rejected: DataFrame, path: str) -> None:
    """Dead letters: appended as JSON lines, geometries in base64."""
    columns = [F.base64(c).alias(c) if isinstance(rejected.schema[c].dataType, T.BinaryType) else F.col(c) for c in rejected.columns]
    rejected.select(*columns).write.mode("append").json(path)


def replay_pending(spark: SparkSession, path: str, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of the dead-letter folder that may go into the journal, those still rejected).

    A replayed event keeps its ``created_at`` and gets a new id after the journal's last; an event that is in the journal
    already (same source, entity, time, operation and payload) isn't replayed again.
    """
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in JOURNAL.fields])
    found = spark.read.schema(text).json(path)
    found = found.select(*[F.unbase64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in JOURNAL.fields])
    good, bad = split_valid(found)
    natural = ["datasource_fingerprint", "entity_fingerprint", "created_at", "operation_type", "attributes_json"]
    good = good.dropDuplicates(natural)
    # Only events at the times of the letters can be theirs.
    times = good.select(F.col("created_at").alias("j_created_at")).distinct()
    there = journal.select(*[F.col(c).alias(f"j_{c}") for c in natural]).join(times, "j_created_at", "left_semi")
    fresh = good.join(there, F.expr(" AND ".join(f"{c} <=> j_{c}" for c in natural)), "left_anti")
    # Ids only need to be new and grow: the task number leads, so no task waits for another.
    last = journal.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("last"))
    fresh = fresh.withColumn("row", F.monotonically_increasing_id()).crossJoin(F.broadcast(last))
    return fresh.withColumn("event_id", F.col("last") + 1 + F.col("row")).select(*JOURNAL.names), bad


def register_sources(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The registry after upserting ``seen`` (both: datasource_fingerprint, provider_type, source_uri, layer_name,
    last_seen_at): the latest row of each fingerprint, without passwords."""
    rows = registry.unionByName(seen.withColumn("source_uri", identity.without_password("source_uri")))
    latest = F.max_by(F.struct("provider_type", "source_uri", "layer_name", "last_seen_at"), "last_seen_at")
    return rows.groupBy("datasource_fingerprint").agg(latest.alias("x")).select("datasource_fingerprint", "x.*")


def journal_registry(journal: DataFrame) -> DataFrame:
    """A registry row for each source that the journal names, from its latest event."""
    latest = F.max_by(F.struct("provider_type", "layer_name_snapshot", "created_at"), order_key())
    uri = F.split_part(F.col("datasource_fingerprint"), F.lit("::"), F.lit(2))
    return (
        journal.groupBy("datasource_fingerprint")
        .agg(latest.alias("x"))
        .select(
            "datasource_fingerprint",
            F.col("x.provider_type").alias("provider_type"),
            uri.alias("source_uri"),
            F.col("x.layer_name_snapshot").alias("layer_name"),
            F.col("x.created_at").alias("last_seen_at"),
        )
    )


def lookup_source(registry: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """A registry row for each of ``wanted(fingerprint)``: its own, or that of the first of its other names in order.

    Columns: fingerprint, found_as, and the registry's; what is known under no name has no row.
    """
    from stratalog.operators.scope import expanded

    names = expanded(aliases, wanted)
    met = names.join(registry, names["member"] == registry["datasource_fingerprint"])
    rank = F.struct((F.col("member") != F.col("fingerprint")).alias("other"), "member")
    first = met.groupBy("fingerprint").agg(F.min_by(F.struct(*registry.columns), rank).alias("r"))
    return first.select("fingerprint", F.col("r.datasource_fingerprint").alias("found_as"), *[f"r.{c}" for c in registry.columns if c != "datasource_fingerprint"])


def target_layers(events: DataFrame, layers: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """(event_id, layer_id, source_uri, how): the layer that an event would be restored to.

    ``layers`` (layer_id, datasource_fingerprint, source_uri) are those there now. By ``layer``: the event's own id; by
    ``source``: the first layer of its source under any name; by ``registry``: none is there, but the source is known.
    """
    from stratalog.operators.scope import expanded

    used = events.select("event_id", F.col("layer_id_snapshot").alias("layer_id"), "datasource_fingerprint")
    own = layers.select("layer_id", F.col("source_uri").alias("own_uri"), F.lit(True).alias("own"))
    names = expanded(aliases, used.select(F.col("datasource_fingerprint").alias("fingerprint")).distinct())
    canonical = layers.select("layer_id", "source_uri", identity.canonical_fingerprint("datasource_fingerprint").alias("name"))
    near = names.withColumn("name", identity.canonical_fingerprint("member")).join(canonical, "name")
    near = near.groupBy("fingerprint").agg(F.min(F.struct("layer_id", "source_uri")).alias("near"))
    known = lookup_source(registry, aliases, used.select(F.col("datasource_fingerprint").alias("fingerprint")).distinct())
    known = known.select(F.col("fingerprint").alias("known_as"), F.col("source_uri").alias("known_uri"))
    met = used.join(own, "layer_id", "left").join(near, F.col("datasource_fingerprint") == F.col("fingerprint"), "left")
    met = met.join(known, F.col("datasource_fingerprint") == F.col("known_as"), "left")
    how = F.when(F.col("own"), "layer").when(F.col("near").isNotNull(), "source").when(F.col("known_uri").isNotNull(), "registry")
    layer = F.when(F.col("own"), F.col("layer_id")).otherwise(F.col("near.layer_id"))
    return met.select("event_id", layer.alias("layer_id"), F.when(F.col("own"), F.col("own_uri")).otherwise(F.coalesce("near.source_uri", "known_uri")).alias("source_uri"), how.alias("how"))


def as_tsv(rows: DataFrame) -> DataFrame:
    """One ``line`` a row: the columns as text, tab-joined, nulls empty; ``header(rows)`` is the first line."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ")
    return rows.select(F.concat_ws("\t", *[cell(c) for c in rows.columns]).alias("line"))


def header(rows: DataFrame) -> str:
    return "\t".join(rows.columns)


#: Settings and their defaults.
DEFAULT_SETTINGS = {"capture_enabled": "true", "retention_days": "365", "max_events": "1000000", "capture_inserts": "true"}


def settings(stored: DataFrame) -> DataFrame:
    """setting_key, setting_value: the stored values over the defaults."""
    spark = stored.sparkSession
    defaults = spark.createDataFrame(list(DEFAULT_SETTINGS.items()), "setting_key string, default_value string")
    both = defaults.join(stored.select("setting_key", "setting_value"), "setting_key", "full_outer")
    return both.select("setting_key", F.coalesce("setting_value", "default_value").alias("setting_value"))


def changed_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored settings after ``changes(setting_key, setting_value)``: a change replaces, a null value takes away."""
    kept = stored.select("setting_key", "setting_value").join(changes.select("setting_key"), "setting_key", "left_anti")
    return kept.unionByName(changes.where("setting_value IS NOT NULL").select("setting_key", "setting_value"))


def journal_path(folder: str, project: str | None = None) -> str:
    """Where a project's journal is kept under ``folder``: by its name beside it, or by a digest where it has none yet."""
    name = re.sub(r"\.[^./]*$", "", project.rstrip("/").rpartition("/")[2]) if project else ""
    return f"{folder.rstrip('/')}/{name or 'unsaved-' + hashlib.sha256((project or '').encode()).hexdigest()[:16]}.journal"


class Journal:
    """One journal by its path: appending, searching and counting, for callers that don't hold DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        return read_journal(self.spark, self.path)

    def last_id(self) -> int:
        """The largest event id, 0 for a journal without events or files."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return 0
        return self.events().agg(F.max("event_id")).first()[0] or 0

    def append(self, events: DataFrame, pending: str | None = None) -> None:
        """Writes the valid events; the others go to the dead letters in ``pending``, or raise.

        Events without an id get the ids behind the last one of the journal and of this batch, in the order of their time.
        A journal has one writer: two that append at once could give an id twice.
        """
        from stratalog.session import settled, settled_here
        from stratalog.streaming.capture import numbered

        with settled_here():
            good, bad = split_valid(events)
            if pending:
                write_pending(bad, pending)
            elif bad.limit(1).count():
                raise ValueError(f"events can't be written: {bad.select('reason').first()[0]}")
            good = settled(good.select(*JOURNAL.names))
            own = good.agg(F.max("event_id")).first()[0] or 0
            write_journal(numbered(good, max(own, self.last_id()) + 1), self.path)

    def of_source(self, fingerprint: str) -> DataFrame:
        return of_source(self.events(), fingerprint)

    def event(self, event_id: int) -> DataFrame:
        return event_by_id(self.events(), event_id)

    def search(self, criteria, page: int = 1, size: int = 100) -> DataFrame:
        from stratalog.operators.search import search_page

        return search_page(self.events(), criteria, page, size)

    def count(self, criteria) -> int:
        from stratalog.operators.search import count_matching

        return count_matching(self.events(), criteria).first()[0]

    def users(self) -> DataFrame:
        from stratalog.operators.search import distinct_users

        return distinct_users(self.events())
