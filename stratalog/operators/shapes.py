"""Shapes that are equal within a tolerance, found by an equi-join.

Shapes of the same bytes are one, however many rows have them, so a shape that a third of all rows share is compared once.
Different ones can only be equal within the tolerance if the lower corners of their envelopes are: each corner becomes a
box as wide as the tolerance there, and boxes meet on grid cells (``cells``), so a pair that lies on both sides of a cell's
edge is found too. Their number of parts and points must be equal and their envelopes near; only then are the coordinates
compared, once for each pair of shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import geometry
from stratalog.operators import cells
from stratalog.session import settled

SOURCE = "datasource_fingerprint"
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def distinct_shapes(rows: DataFrame) -> DataFrame:
    """(datasource_fingerprint, digest, shape, s): the different shapes of each source, with their signature."""
    drawn = rows.where("geometry_wkb IS NOT NULL").select(SOURCE, F.sha2("geometry_wkb", 256).alias("digest"), F.col("geometry_wkb").alias("shape"))
    return settled(drawn.groupBy(SOURCE, "digest").agg(F.first("shape").alias("shape")).withColumn("s", geometry.signature("shape")))


def _corner(shapes: DataFrame) -> DataFrame:
    """Shapes as boxes round their lower corner, half as wide as what two of them may be apart."""
    reach = lambda c: F.lit(geometry.TOLERANCE) * (1 + F.abs(F.col(f"s.{c}")))
    sides = [(F.col("s.xmin") - reach("xmin")), (F.col("s.ymin") - reach("ymin")), (F.col("s.xmin") + reach("xmin")), (F.col("s.ymin") + reach("ymin"))]
    box = F.struct(*[e.alias(c) for c, e in zip(CORNERS, sides)])
    return shapes.select(SOURCE, F.col("digest").alias("id"), box.alias("box"), F.col("s.parts").alias("parts"), F.col("s.points").alias("points"), F.col("s.kinds").alias("kinds"))


def near(left: DataFrame, right: DataFrame) -> DataFrame:
    """(datasource_fingerprint, a, b): digests of ``distinct_shapes`` on both sides that are equal within the tolerance."""
    same = left.select(SOURCE, F.col("digest").alias("a")).join(right.select(SOURCE, F.col("digest").alias("a")), [SOURCE, "a"]).withColumn("b", F.col("a"))
    tell = lambda x: _corner(x).withColumn("id", F.struct(SOURCE, "id"))
    pairs = cells.met(tell(left), tell(right), (SOURCE, "parts", "points", "kinds"))
    pairs = pairs.select(F.col(f"id.{SOURCE}").alias(SOURCE), F.col("id.id").alias("a"), F.col("asked_id.id").alias("b")).where("a <> b")
    one = left.select(SOURCE, F.col("digest").alias("a"), F.col("shape").alias("x"), F.col("s").alias("sx"))
    other = right.select(SOURCE, F.col("digest").alias("b"), F.col("shape").alias("y"), F.col("s").alias("sy"))
    met = pairs.join(one, [SOURCE, "a"]).join(other, [SOURCE, "b"])
    for c in CORNERS:
        met = met.where(F.abs(F.col(f"sx.{c}") - F.col(f"sy.{c}")) <= 2 * F.lit(geometry.TOLERANCE) * (1 + F.abs(F.col(f"sy.{c}"))))
    return same.unionByName(met.where(geometry.same_shape(F.col("x"), F.col("y"))).select(SOURCE, "a", "b"))


def matches(events: DataFrame, rows: DataFrame) -> DataFrame:
    """(event_id, n_rows, lowest): how many rows have an event's geometry within the tolerance, and the lowest of them.

    ``events``: datasource_fingerprint, event_id, geometry_wkb; ``rows``: datasource_fingerprint, fid, geometry_wkb. Events
    without such a row, or without a geometry, don't appear. Shapes that can't be read equal those of the same bytes only.
    """
    asked, held = distinct_shapes(events), distinct_shapes(rows)
    digest = F.sha2("geometry_wkb", 256)
    counts = rows.where("geometry_wkb IS NOT NULL").groupBy(SOURCE, digest.alias("b")).agg(F.count("*").alias("n"), F.min("fid").alias("low"))
    sums = near(asked, held).join(counts, [SOURCE, "b"]).groupBy(SOURCE, "a").agg(F.sum("n").alias("n_rows"), F.min("low").alias("lowest"))
    return events.select(SOURCE, "event_id", digest.alias("a")).join(sums, [SOURCE, "a"]).select("event_id", "n_rows", "lowest")
