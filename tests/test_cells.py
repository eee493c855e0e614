"""The join of boxes on cells against all pairs."""

import random

import pytest

from stratalog.operators import cells

BOX = "id long, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def boxes(rng, n, reach, sizes):
    out = []
    for k in range(n):
        x, y = (rng.choice([rng.uniform(-reach, reach), float(rng.randrange(-4, 5))]) for _ in range(2))
        w, h = (rng.choice([0.0, 1.0, rng.uniform(0, 1)]) * rng.choice(sizes) for _ in range(2))
        out.append((k, (x, y, x + w, y + h)))
    return out


@pytest.mark.parametrize("seed, reach, sizes", [(1, 8.0, [0.25, 1.0, 2.0]), (2, 1000.0, [1e-9, 1.0, 64.0, 3000.0]), (3, 1e15, [1.0, 1e14, 1e18])])
def test_against_all_pairs(spark, seed, reach, sizes):
    rng = random.Random(seed)
    rows, asked = boxes(rng, 150, reach, sizes), boxes(rng, 60, reach, sizes)
    rows += [(900, None), (901, (float("nan"), 0.0, 1.0, 1.0)), (902, (2.0, 2.0, 2.0, 2.0))]
    asked += [(902, (2.0, 2.0, 2.0, 2.0)), (903, None)]
    found = [tuple(r) for r in cells.met(spark.createDataFrame(rows, BOX), spark.createDataFrame(asked, BOX)).collect()]
    want = {
        (i, k) for i, a in rows for k, b in asked
        if a and b and a[0] == a[0] and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]
    }
    assert len(found) == len(set(found)) and set(found) == want and (902, 902) in want


def test_no_boxes(spark):
    none = spark.createDataFrame([], BOX)
    some = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0))], BOX)
    assert cells.met(none, some).count() == cells.met(some, none).count() == 0
