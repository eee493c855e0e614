"""Statistics of each source, kept up to date batch by batch.

A batch of a stream leaves one narrow partial of its own, under its number: counts, first and last times, operations, and
sketches of users and entities of a fixed size. A batch that is run again replaces its partial, so nothing counts twice.
Partials merge in any order; ``fold`` makes one of many, and a reader never sees a batch both folded and by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import settled, settled_here
from stratalog.sources.journal import is_trace

SOURCE = "datasource_fingerprint"
#: Of a sketch: about 1.6 percent off at most two times in three, in 4 KB.
LOG_SIZE = 12
PARTIAL = (
    f"{SOURCE} string, n_events long, n_user_events long, first_at string, last_at string, operations array<string>, users binary, entities binary, batch long"
)


def partial(events: DataFrame) -> DataFrame:
    """One row per source of what a batch adds."""
    return events.groupBy(SOURCE).agg(
        F.count("*").alias("n_events"),
        F.count_if(~is_trace()).alias("n_user_events"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.array_sort(F.collect_set("operation_type")).alias("operations"),
        F.hll_sketch_agg("user_name", LOG_SIZE).alias("users"),
        F.hll_sketch_agg("entity_fingerprint", LOG_SIZE).alias("entities"),
    )


def write_partial(events: DataFrame, batch_id: int, path: str) -> None:
    partial(events).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def partials(spark: SparkSession, path: str) -> DataFrame:
    """The partials that count: the last fold, which stands under ``-(n + 1)`` for batches up to n, and the batches behind it."""
    every = spark.read.schema(PARTIAL).parquet(path)
    base = every.agg(F.min("batch")).first()[0]
    return every if base is None or base >= 0 else every.where((F.col("batch") == base) | (F.col("batch") > -(base + 1)))


def merged(rows: DataFrame) -> DataFrame:
    """The statistics of each source: counts, times, operations, and estimates of distinct users and entities."""
    sums = _sums(rows)
    estimate = lambda c: F.hll_sketch_estimate(c).alias(f"n_{c}_about")
    return sums.select(SOURCE, "n_events", "n_user_events", "first_at", "last_at", "operations", estimate("users"), estimate("entities"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(SOURCE).agg(
        F.sum("n_events").alias("n_events"),
        F.sum("n_user_events").alias("n_user_events"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("operations")))).alias("operations"),
        F.hll_union_agg("users").alias("users"),
        F.hll_union_agg("entities").alias("entities"),
    )


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Makes one partial of all batches up to ``upto``, which must be done with, and deletes theirs.

    The fold is whole before anything is deleted; where it stops in between, the batches that are still there are passed over.
    """
    with settled_here():
        rows = partials(spark, path)
        own = settled(_sums(rows.where(F.col("batch") <= upto)))
        own.write.mode("overwrite").parquet(f"{path}/batch={-(upto + 1)}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for place in files.listStatus(folder):
        name = place.getPath().getName()
        if name.startswith("batch=") and -(upto + 1) < int(name.removeprefix("batch=")) <= upto:
            files.delete(place.getPath(), True)
