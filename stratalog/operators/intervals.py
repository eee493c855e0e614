"""The state at many instants at once, from the intervals in which values held.

A value of a field, a shape or an operation holds from the event that writes it to the next one that does. Told in places
among the sorted cutoffs instead of in time, an interval is a range of cutoffs, and only the last write before each cutoff
counts. So a cell has at most as many intervals as there are cutoffs, the writes between two of them combine on the map
side, and what is expanded in the end is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import moments
from stratalog.operators import snapshot
from stratalog.session import settled
from stratalog.sources.journal import is_active

#: Cutoffs of one pass; more are taken in blocks. Buckets of time in which an event looks for its place among them.
BLOCK, BUCKETS = 2048, 1024
#: Times that sort as text as they do in time.
UNIFORM = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?\+00:00$"
CELL = [*snapshot.KEYS, "kind", "field"]


def _placed(cells: DataFrame, cutoffs: list[str]) -> DataFrame:
    """``cells`` with ``place``: how many of the sorted ``cutoffs`` lie before the event.

    An event meets the cutoffs of its bucket of time alone; a bucket is a row that says how many cutoffs lie before it.
    """
    spark = cells.sparkSession
    text = [moments.normalised_cutoff(x) for x in cutoffs]
    told = spark.createDataFrame(list(zip(range(len(cutoffs)), text, cutoffs)), "n int, text string, at string")
    told = told.withColumn("t", F.unix_micros(moments.instant("at"))).orderBy("n").collect()  # the cutoffs that were given
    times = [r["t"] for r in told]
    low, width = min(times), max(1, (max(times) - min(times)) // BUCKETS + 1)
    inside: dict[int, list[str]] = {}
    for r in told:
        inside.setdefault((r["t"] - low) // width, []).append(r["text"])
    rows, before = [], 0
    for n in range(BUCKETS + 1):
        rows.append((n, before, inside.get(n, [])))
        before += len(inside.get(n, []))
    buckets = spark.createDataFrame(rows, "_bucket long, _before int, _texts array<string>")
    at = F.unix_micros(moments.instant("k.created_at"))
    uniform = F.when(F.col("k.created_at").rlike(UNIFORM), at).otherwise(F.raise_error(F.concat(F.lit("not a uniform time: "), F.col("k.created_at"))))
    bucket = F.floor((uniform - low) / F.lit(width))
    cells = cells.withColumn("_bucket", F.greatest(F.least(bucket, F.lit(BUCKETS)), F.lit(-1)))
    met = cells.join(F.broadcast(buckets), "_bucket", "left")
    place = F.coalesce(F.col("_before") + F.size(F.filter("_texts", lambda c: c < F.col("k.created_at"))), F.lit(0))
    return met.withColumn("place", place).drop("_bucket", "_before", "_texts")


def intervals(events: DataFrame, cutoffs: list[str]) -> DataFrame:
    """datasource_fingerprint, entity, kind, field, ``v`` (value, wkb, crs, k), ``since`` and ``until``: the first of the sorted
    ``cutoffs`` at which a value holds and the first at which it doesn't any more."""
    cells = _placed(snapshot.cells_of(snapshot.effective_events(events.where(is_active()))), cutoffs)
    seen = cells.where(F.col("place") < len(cutoffs))
    best = seen.groupBy(*CELL, F.col("place").alias("since")).agg(F.max_by(F.struct("value", "wkb", "crs", "k"), "k").alias("v"))
    until = F.lead("since", 1, len(cutoffs)).over(Window.partitionBy(*CELL).orderBy("since"))  # at most a row a cutoff
    return best.withColumn("until", until)


def states_at(events: DataFrame, cutoffs: list[str]) -> DataFrame:
    """``snapshot.state_at`` of every cutoff, with ``at``, in one job for each 2,048 of them.

    Cutoffs are written as for ``state_at``; the same one twice gives its rows once. Times of events must be spelled in UTC
    with ``+00:00``, as the journal's writer does; another spelling is refused, as its text would sort against its time.
    """
    unreadable = [x for x in cutoffs if moments.normalised_cutoff(x) is None]
    if unreadable or not cutoffs:
        raise ValueError(f"no instants to read the state at: {unreadable[:3]}")
    every = sorted(set(cutoffs), key=moments.normalised_cutoff)
    out = None
    for n in range(0, len(every), BLOCK):
        block = every[n : n + BLOCK]
        # Dealt by entity before they are told to their cutoffs, so that these make no rows of a shuffle; an entity has at most
        # a row for each cutoff of each of its fields.
        held = settled(intervals(events, block)).select(*CELL, "v.value", "v.wkb", "v.crs", "v.k.created_at", "v.k.event_id", "since", "until")
        held = held.repartition(*snapshot.KEYS).withColumn("at", F.explode(F.expr("sequence(since, until - 1)")))
        held = held.withColumn("v", F.struct("value", "wkb", "crs", F.struct("created_at", "event_id").alias("k")))
        names = F.array(*[F.lit(x) for x in block])
        rows = snapshot.rows_of(held, [*snapshot.KEYS, "at"]).withColumn("at", F.get(names, F.col("at")))
        out = rows if out is None else out.unionByName(rows)
    return out
