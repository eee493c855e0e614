"""Ordered scans over groups of any size, in two levels.

A window over a group sorts it in one task; a group with a third of all rows would hold up a job. Here the rows are dealt
by ranges of (group, order), so a large group lies in several buckets that follow each other. Windows run inside buckets.
What earlier or later buckets of the same group add comes from a summary of each: only the first and the last group of a
bucket can go on in another one, so there are at most two summaries a bucket, however many groups there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stratalog.session import settled

BUCKET = "_bucket"


def bucketed(rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of ``keys`` and ``order``, with ``_bucket``: ascending along each group.

    Rows that are equal in both share a bucket. The table is written once, as another run may draw other ranges. ``parts``
    is the number of ranges; by default Spark takes as many as the rows need.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return settled(dealt.withColumn(BUCKET, F.spark_partition_id()))


def line(keys: list[str], order: list[str | Column]) -> WindowSpec:
    """The rows of a group inside a bucket, in order."""
    return Window.partitionBy(BUCKET, *keys).orderBy(*order)


def _buckets(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(BUCKET)


def earlier(keys: list[str]) -> WindowSpec:
    """The buckets of a group before one."""
    return _buckets(keys).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: list[str]) -> WindowSpec:
    """The buckets of a group after one."""
    return _buckets(keys).rowsBetween(1, Window.unboundedFollowing)


def carried(rows: DataFrame, keys: list[str], summary: Callable[[DataFrame], DataFrame], *steps: dict[str, Column]) -> DataFrame:
    """``bucketed`` rows with what the other buckets of their group add; null where the group has no other bucket.

    ``summary`` makes one row for each ``_bucket`` and group of the rows that it gets. ``steps`` name columns over these
    summaries, with ``earlier`` and ``later`` as windows; the last step's columns are added to the rows, a step sees those
    before it.

    Plan: one pass for the ends of the buckets, one over the groups that go on, and a broadcast of at most two rows a bucket.
    """
    key = F.struct(*keys).alias("_key")
    ends = rows.select(BUCKET, key).groupBy(BUCKET).agg(F.array_distinct(F.array(F.min("_key"), F.max("_key"))).alias("_keys"))
    ends = ends.select(BUCKET, F.explode("_keys").alias("_key"))
    going_on = ends.withColumn("_n", F.count("*").over(Window.partitionBy("_key"))).where("_n > 1")
    going_on = going_on.select(F.col(BUCKET).alias("_b"), F.col("_key").alias("_k"))
    both = (F.col(BUCKET) == F.col("_b")) & F.struct(*keys).eqNullSafe(F.col("_k"))
    found = summary(rows.join(F.broadcast(going_on), both, "left_semi"))
    for step in steps:
        found = found.withColumns(step)
    found = found.select(F.col(BUCKET).alias("_b"), F.struct(*keys).alias("_k"), *steps[-1])
    return rows.join(F.broadcast(found), both, "left").drop("_b", "_k")
