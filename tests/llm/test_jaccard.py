import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm.components import connected_components
from stratalog.llm.jaccard import _suffix_filter, bits_apart, parities, similar_groups
from stratalog.llm.shared import Workspace

from .helpers import docs_frame, words

FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    key = lambda i: float("inf") if i is None else i
    sets = [shingles(t, k) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), float("inf")), key(d))
    clean = lambda x: None if x == float("inf") else x
    return sorted(str((d, len(sets[i]), clean(least[root(i)]) if sets[i] else d)) for i, (d, _, _) in enumerate(rows))


def fixture(seed):
    rng = random.Random(seed)
    make = lambda n, v=500: [rng.choice(["W", "w"]) + str(rng.randrange(v)) for _ in range(n)]
    rows, bases = [], [make(rng.randrange(40, 120)) for _ in range(6)]
    for i in range(260):
        w = list(bases[0] if i % 2 else rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], make(1), make(2)])
        rows.append((i, " ".join(w), "s"))
    rows += [(300 + i, " ".join(bases[1][:40] + make(60)), "s") for i in range(40)]
    rows += [(400 + i, " ".join(make(rng.randrange(0, 5), 3)), "s") for i in range(60)]
    return [*rows, (500, None, "s"), (501, "", "s"), (502, " ", "s"), (3, rows[3][1], "s"), (None, rows[4][1], "s"), (None, "only here", "s"), (None, "or here", "s")]


@pytest.mark.parametrize("k, percent, full, deep", [(3, 90, 24, 2048), (5, 80, 4, 12), (3, 80, 6, 2048)])
def test_matches_brute_force(spark, k, percent, full, deep):
    rows = fixture(k * percent)
    got = similar_groups(docs_frame(spark, rows), Workspace(spark, "t"), k, percent, full_list=full, deep_list=deep, broadcast_ids=1_000_000 if k == 3 else 0).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows, k, percent)


def test_empty_table(spark):
    assert similar_groups(docs_frame(spark, []), Workspace(spark, "t")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(3, 3), (5, 5), (None, 4), (60, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {i: 100 for i in range(101, 141)} | {k: 7 for k in range(20, 61)}


def test_copies_of_one_set_make_no_list(spark):
    from stratalog.llm import jaccard
    from stratalog.llm.shared import Workspace

    space = Workspace(spark, "t")
    rows = [(0, 1, 5, 10, 0, False)] * 3 + [(0, 2, 5, 10, 1, False), (0, 2, 6, 10, 0, False)] * 2
    pairs = jaccard._candidates(spark.createDataFrame(rows, jaccard.POSTING_SQL), space, 0, 80, 24).collect()
    assert [(r["a"], r["b"], r["hub"]) for r in pairs] == [(5, 6, False)]
    assert sorted(r["node"] for r in spark.read.parquet(f"{space.path}/lists0").collect()) == [5, 6]


def test_suffix_filter_tells_long_sets_apart(spark, monkeypatch):
    draw = random.Random(5)
    long = [[f"w{draw.randrange(10**6)}" for _ in range(9000)] for _ in range(3)]
    near = [*long[0][:8900], *(f"w{draw.randrange(10**6)}" for _ in range(150))]
    space = Workspace(spark, "test-suffix")
    monkeypatch.setattr(Workspace, "drop", lambda self, name="": None)
    found = similar_groups(docs_frame(spark, [(i, " ".join(x), "en") for i, x in enumerate([*long, near])]), space, words=3, percent=90).collect()
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 1, 2: 2, 3: 0}
    heads = spark.read.parquet(f"{space.path}/heads0")
    ids = heads.select(F.col("head.id").alias("i"), "node")
    pairs = ids.select(F.col("i").alias("x"), F.col("node").alias("a")).crossJoin(ids.select(F.col("i").alias("y"), F.col("node").alias("b"))).where("x < y")
    pairs = pairs.select(F.lit(0).cast("long").alias("ctx"), "a", "b", F.lit(False).alias("hub"))
    node = {r.i: r.node for r in ids.collect()}
    assert [{r.a, r.b} for r in _suffix_filter(pairs, heads, 90).collect()] == [{node[0], node[3]}]
    space.drop()


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000, 5000])
def test_bits_apart_never_pass_the_difference(size):
    draw = np.random.default_rng(size)
    a = np.unique(draw.integers(0, 2**63, size, np.uint64))
    for more in (0, 1, size // 10, 3 * size):
        b = np.unique(np.concatenate([a[more // 2 :], draw.integers(0, 2**63, more, np.uint64)]))
        rows, values = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
        x, y = parities(rows, values, np.array([len(a), len(b)])).to_pylist()
        assert bits_apart(x, y) <= len(np.setxor1d(a, b)) and bits_apart(x, y) == bits_apart(y, x)


def test_lists_by_chance_fall_apart_by_size(spark):
    from stratalog.llm import jaccard

    space = Workspace(spark, "t")
    rows = [(0, 1, node, int(10 * 1.5 ** (node // 2)), 0, False) for node in range(2, 62)]
    pairs = jaccard._candidates(spark.createDataFrame(rows, jaccard.POSTING_SQL), space, 0, 90, 24).collect()
    assert sorted((r["a"], r["b"], r["hub"]) for r in pairs) == [(n, n + 1, False) for n in range(2, 62, 2)]


@pytest.mark.parametrize("percent", [1, 50, 80, 90, 99, 100])
def test_similar_sizes_are_of_one_class_or_of_neighbours(spark, percent):
    from stratalog.llm.jaccard import _size_class

    low = spark.range(1, 1500).select(F.col("id").alias("n")).select("n", (100 * F.col("n") / percent).cast("long").alias("m"))
    apart = low.select((_size_class("m", percent) - _size_class("n", percent)).alias("d"))
    assert apart.where("d NOT IN (0, 1)").count() == 0


def test_a_class_of_one_size_keeps_its_hub(spark):
    from stratalog.llm import jaccard

    space = Workspace(spark, "t")
    rows = [(0, 1, node, 100 if node < 40 else 104, node == 7 and 2 or 3, False) for node in range(2, 60)]
    pairs = jaccard._candidates(spark.createDataFrame(rows, jaccard.POSTING_SQL), space, 0, 90, 24).collect()
    assert {(r["a"], r["b"]) for r in pairs if r["hub"]} >= {(7, n) for n in range(2, 60) if n != 7}


def test_prefixes_of_large_differences_come_in_slices():
    import pyarrow as pa

    from stratalog.llm import jaccard

    class Told:
        value = np.zeros(1 << jaccard.COUNTERS_LOG2, np.uint8)

    draw, n, each = np.random.default_rng(3), 60, 20_000
    bodies = [jaccard.body(draw.integers(0, 2**63, each, np.uint64)) for _ in range(n)]
    columns = [[1] * n, list(range(n)), [each] * n, [False] * n, bodies, [bytes(each // 8)] * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, jaccard.SETS, strict=True)], schema=jaccard.SETS)
    out = list(jaccard._delta_prefixes(Told, 80)([batch]))
    assert sum(b.num_rows for b in out) == n * (each // 4 + 1) and max(b.num_rows for b in out) < jaccard.SLICE_ROWS + each
    assert {x for b in out for x in b.column("node").to_pylist()} == set(range(n))
