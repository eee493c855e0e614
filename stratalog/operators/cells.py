"""Boxes against boxes by an equi-join on grid cells of several levels.

A box lies in at most four cells of the level whose cells are as large as it is. Of two boxes that touch, the smaller one's
cells on the larger one's level include one of the larger one's. So each box is told by its cells on its own level and on
those larger levels that occur on the other side; boxes meet where a cell is the same and belongs to one's own level, and
the boxes themselves decide. Levels are powers of two, so neither side needs to know the extent of the other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The smallest level: cells of 2**-24 units.
LOWEST = -24


def _level(box: Column) -> Column:
    size = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return F.when(size > 0, F.greatest(F.ceil(F.log2(size)), F.lit(LOWEST))).otherwise(F.lit(LOWEST)).cast("int")


def _levels(boxes: DataFrame, name: str) -> DataFrame:
    """One row: the levels that occur, a number for each power of two."""
    return F.broadcast(boxes.agg(F.collect_set("level").alias(name)))


def _told(boxes: DataFrame, others: DataFrame, also: list[str]) -> DataFrame:
    """``boxes`` by cell: (id, box, level of the cell, x, y, own: whether that is the box's level)."""
    met = boxes.crossJoin(others).withColumn("at", F.explode(F.array_union(F.array("level"), F.filter("_levels", lambda x: x > F.col("level")))))
    size = F.pow(F.lit(2.0), F.col("at"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))
    met = met.withColumn("x", F.explode(span("box.xmin", "box.xmax"))).withColumn("y", F.explode(span("box.ymin", "box.ymax")))
    return met.select("id", "box", *also, "at", "x", "y", (F.col("at") == F.col("level")).alias("own"))


def met(boxes: DataFrame, asked: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, asked_id): boxes that touch or overlap; both inputs are ``(id, box struct<xmin,ymin,xmax,ymax>)``, with columns
    ``also`` that must be equal too.

    Unknown boxes (null) and coordinates that are no finite numbers meet nothing. Boxes on coordinates that long integers
    of small cells can't hold are met on a coarser level. Each pair comes once.
    """
    finite = reduce(and_, [F.abs(F.col(f"box.{c}")) < F.lit(1e300) for c in ("xmin", "ymin", "xmax", "ymax")])
    good = lambda b: b.where(F.coalesce(finite, F.lit(False)))
    reach = F.greatest(*[F.abs(F.col(f"box.{c}")) for c in ("xmin", "ymin", "xmax", "ymax")])
    # Coordinates of 2**38 units and more take cells so large that their numbers stay below 2**62.
    least = F.greatest(F.lit(LOWEST), F.ceil(F.log2(F.greatest(reach, F.lit(1.0)))).cast("int") - 61)
    both = [good(b).withColumn("level", F.greatest(_level(F.col("box")), least)) for b in (boxes, asked)]
    rows, wants = both
    a = _told(rows, _levels(wants, "_levels"), list(also))
    b = _told(wants, _levels(rows, "_levels"), list(also)).select(F.col("id").alias("asked_id"), F.col("box").alias("b"), *also, "at", "x", "y", F.col("own").alias("own_b"))
    pairs = a.join(b, [*also, "at", "x", "y"]).where(F.col("own") | F.col("own_b"))
    touch = (F.col("box.xmin") <= F.col("b.xmax")) & (F.col("box.xmax") >= F.col("b.xmin")) & (F.col("box.ymin") <= F.col("b.ymax")) & (F.col("box.ymax") >= F.col("b.ymin"))
    return pairs.where(touch).select("id", "asked_id").distinct()
