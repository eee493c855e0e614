"""The tolerant join of shapes against comparing all pairs."""

import random
import struct

from pyspark.sql import functions as F

from stratalog.functions import geometry
from stratalog.operators import shapes

SCHEMA = "datasource_fingerprint string, {} long, geometry_wkb binary"


def point(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def polygon(ring):
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def square(x, y, side, start=0, back=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    ring = ring[start:] + ring[:start]
    ring = ring[::-1] if back else ring
    return polygon([*ring, ring[0]])


def test_near_shapes_on_both_sides_of_a_cell_edge(spark):
    rng = random.Random(5)
    edge = 2.0**-24
    drawn = [point(k * edge + d, 1.0) for k in range(3) for d in (-4e-10, 4e-10)] + [point(1e7 + d, -5.0) for d in (0.0, 5e-3, 5e-2)]
    drawn += [square(edge - 3e-10, 2.0, 1.0), square(edge + 3e-10, 2.0, 1.0, 2, True), square(edge, 2.0, 1.0 + 1e-6), square(edge, 2.0, 1.0, 1)]
    drawn += [point(rng.choice([0.0, 1.0]) + rng.choice([0, 1e-10, 1e-8]), rng.choice([0.0, -1e-10])) for _ in range(30)] + [b"\x01\x02", None, b""]
    left = [("s" if rng.random() < 0.8 else "t", k, x) for k, x in enumerate(drawn)]
    right = [("s" if rng.random() < 0.8 else "t", k, x) for k, x in enumerate(drawn[::-1])]
    events, rows = spark.createDataFrame(left, SCHEMA.format("event_id")), spark.createDataFrame(right, SCHEMA.format("fid"))
    want = {}
    for s, k, x in left:
        found = [f for t, f, y in right if s == t and x is not None and y is not None and (x == y or geometry._same(x, y))]
        if found:
            want[k] = (len(found), min(found))
    assert {r["event_id"]: (r["n_rows"], r["lowest"]) for r in shapes.matches(events, rows).collect()} == want
    assert sum(n > 1 for n, _ in want.values()) > 10


def test_a_shape_of_many_rows_is_compared_once(spark):
    rows = spark.range(2000).select(F.lit("s").alias("datasource_fingerprint"), F.col("id").alias("fid"), F.lit(point(1.0, 1.0)).alias("geometry_wkb"))
    events = rows.withColumnRenamed("fid", "event_id").withColumn("geometry_wkb", F.lit(point(1.0 + 1e-10, 1.0)))
    assert shapes.near(shapes.distinct_shapes(events), shapes.distinct_shapes(rows)).count() == 1
    found = shapes.matches(events, rows)
    assert found.count() == 2000 and found.select("n_rows", "lowest").distinct().collect() == [(2000, 0)]
    assert shapes.matches(events.limit(0), rows).count() == 0
