"""Capture: edits into journal events, as a stream and from two states; and the journal's sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.functions import identity, payload
from stratalog.session import settled, settled_here
from stratalog.sources.journal import JOURNAL, is_trace, split_valid, write_journal
from stratalog.streaming import statistics

KEYS = ["datasource_fingerprint", "entity"]
CHANGES_DDL = """
    datasource_fingerprint string, provider_type string, layer_name string, fid string, user_name string, session_id string,
    committed_at string, writer string, old_attributes map<string,string>, new_attributes map<string,string>,
    old_geometry binary, new_geometry binary
"""


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Operations that lead from one state to another: datasource_fingerprint, entity, operation_type, delta, old and new
    attributes and geometry. Entities whose values and geometry are the same have no row."""
    b = before.select(*KEYS, F.col("attributes").alias("old"), F.col("geometry_wkb").alias("old_geometry"), F.lit(True).alias("was"))
    a = after.select(*KEYS, F.col("attributes").alias("new"), F.col("geometry_wkb").alias("new_geometry"), F.lit(True).alias("is"))
    met = b.join(a, KEYS, "full_outer").withColumn("delta", payload.delta_between(F.col("old"), F.col("new")))
    moved = ~F.col("old_geometry").eqNullSafe(F.col("new_geometry"))
    op = F.when(F.col("was").isNull(), "INSERT").when(F.col("is").isNull(), "DELETE").when(F.col("delta").isNotNull() | moved, "UPDATE")
    return met.withColumn("operation_type", op).where("operation_type IS NOT NULL").drop("was", "is")


def events_of(changes: DataFrame, own_writer: str = "restore") -> DataFrame:
    """Journal events of committed changes (``CHANGES_DDL``: before and after images); stateless, so it serves streams.

    Changes that the engine itself writes are left out, as are updates that change neither values nor geometry.
    """
    c = changes.where(~F.col("writer").eqNullSafe(own_writer))
    old, new = F.col("old_attributes"), F.col("new_attributes")
    op = F.when(old.isNull(), "INSERT").when(new.isNull(), "DELETE").otherwise("UPDATE")
    delta = payload.delta_between(old, new)
    delta = F.map_filter(F.coalesce(delta, F.create_map().cast("map<string,struct<old:string,new:string>>")), lambda k, _: ~payload.is_audit_field(k))
    moved = ~F.col("old_geometry").eqNullSafe(F.col("new_geometry"))
    body = F.when(op == "UPDATE", payload.to_payload(delta)).otherwise(payload.to_full_payload(F.coalesce(new, old)))
    made = c.where((op != "UPDATE") | (F.size(delta) > 0) | moved)
    shape = F.when(op == "INSERT", F.col("new_geometry")).when((op == "UPDATE") & ~moved, None).otherwise(F.col("old_geometry"))
    filled = {
        "datasource_fingerprint": F.col("datasource_fingerprint"),
        "provider_type": F.col("provider_type"),
        "layer_name_snapshot": F.col("layer_name"),
        "feature_identity_json": F.to_json(F.struct(F.col("fid").alias("fid"))),
        "operation_type": op,
        "attributes_json": body,
        "geometry_wkb": shape,
        "new_geometry_wkb": F.when((op == "INSERT") | ((op == "UPDATE") & moved), F.col("new_geometry")),
        "user_name": F.col("user_name"),
        "session_id": F.col("session_id"),
        "created_at": F.col("committed_at"),
        "entity_fingerprint": F.concat(F.lit("fid:"), F.col("fid")),
        "event_schema_version": F.lit(6),
    }
    return made.select(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOURNAL.fields])


def net_effect(edits: DataFrame) -> DataFrame:
    """One row per entity that a commit really changed: its first old image, last new image and ``kind``.

    ``edits``: datasource_fingerprint, entity, seq, kind (added, modified, deleted), old, new. The first old image is kept;
    a delete supersedes changes; what was added and deleted leaves nothing.
    """
    kinds = {k: F.max(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")}
    out = edits.groupBy(*KEYS).agg(F.min_by("old", "seq").alias("old"), F.max_by("new", "seq").alias("new"), *kinds.values())
    kind = F.when(F.col("deleted"), "deleted").when(F.col("added"), "added").otherwise("modified")
    return out.where("NOT (added AND deleted)").select(*KEYS, kind.alias("kind"), "old", "new")


#: Fields that tell events of one batch apart, in the order in which they get their ids.
NATURAL = [
    "created_at", "datasource_fingerprint", "entity_fingerprint", "operation_type", "attributes_json", "session_id", "user_name", "feature_identity_json",
    "geometry_wkb", "new_geometry_wkb", "restored_from_event_id",
]


def numbered(events: DataFrame, first: int) -> DataFrame:
    """``events`` with ids from ``first`` on, without gaps, for those that have none; the same on every run.

    Events are sorted by ``NATURAL`` into ranges; each range counts its own, and the counts, a row a range, give where it
    begins. So no task sees all events, and ids follow time. Events that are alike in all of these are interchangeable.
    """
    own = events.where("event_id IS NOT NULL")
    bare = events.where("event_id IS NULL")
    if not bare.limit(1).count():
        return events
    placed = settled(bare.repartitionByRange(*NATURAL).sortWithinPartitions(*NATURAL).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    met = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")  # a row a task
    number = F.lit(first) + F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.unionByName(met.withColumn("event_id", number).select(*events.columns))


def append_batch(events: DataFrame, batch_id: int, path: str, pending: str, stats: str | None = None) -> None:
    """A micro-batch into the journal; what isn't valid goes to the dead letters. A batch that is run again after a
    failure overwrites its own files with the same ids, so each event ends in one of the two, once. A batch has 2**36 ids
    of its own, which follow the order of its events. ``stats`` is where the batch leaves its partial of the statistics
    (``statistics``), after its events are there."""
    good, bad = split_valid(events)
    with settled_here():
        write_journal(numbered(good, (batch_id + 1) << 36), f"{path}/batch={batch_id}", "overwrite")
    bad.write.mode("overwrite").json(f"{pending}/batch={batch_id}")
    if stats:
        statistics.write_partial(good, batch_id, stats)


def journal_sink(stream: DataFrame, path: str, pending: str, checkpoint: str, available_now: bool = True, stats: str | None = None) -> StreamingQuery:
    """Runs a stream of events into a journal. No watermark: late events keep their time and are never dropped."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path, pending, stats)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of committed changes from a folder of Parquet files; the files taken at once bound a batch."""
    return spark.readStream.schema(CHANGES_DDL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of a stream per source, operation and time window, for events at most ``late`` behind."""
    at = F.col("created_at").try_cast("timestamp")
    seen = stream.where(~is_trace()).withColumn("at", at).withWatermark("at", late)
    return seen.groupBy(F.window("at", width), "datasource_fingerprint", "operation_type").agg(F.count("*").alias("n_events"))


def admitted(stream: DataFrame, selection: list[str] | None) -> DataFrame:
    """Events of the selected sources, in whichever equal form these are named; no selection takes all."""
    if not selection:
        return stream
    wanted = [identity.canonical_fingerprint(F.lit(x)) for x in selection]
    return stream.where(identity.canonical_fingerprint("datasource_fingerprint").isin(*wanted))


def pressure(queued: Column | str) -> Column:
    """What a writer should do at a queue length: go on, warn, flush early or refuse."""
    q = F.col(queued) if isinstance(queued, str) else queued
    return F.when(q >= 50_000, "refuse").when(q >= 40_000, "flush").when(q >= 10_000, "warn").otherwise("go")
