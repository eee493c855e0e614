import itertools
from collections import defaultdict

from pyspark.sql import functions as F

from stratalog.llm.mixing import balance, block_quotas, mix_sources
from stratalog.llm.shared import Workspace

from .helpers import docs_frame, words


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, target = budget * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * sizes[s]]
        if not over:
            target |= {s: w[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_targets_quotas_and_limits(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 3 else "hot") for i in range(6000)]
    rows += [(10_000 + i, "v " * 9, None) for i in range(50)] + [(20_001, None, "s1"), (20_002, "", "empty"), (20_003, " \t", "empty")]
    got = mix_sources(docs_frame(spark, rows), Workspace(spark, "t")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    texts = {i: t for i, t, _ in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == len(words(texts[r.doc_id]))
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(size)
    for s in size:
        assert abs(target[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 0.02 * max(400, want[s])
    again = mix_sources(docs_frame(spark, rows[::-1]).repartition(7), Workspace(spark, "t")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_sainte_lague_seats(spark):
    parts = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4}
    frame = spark.createDataFrame([(0, s, p) for s, p in parts.items()], "shard int, source string, part double")
    got = {r.source: r.quota for r in block_quotas(frame, 17).collect()}
    best = sorted(((p / (2 * k + 1), s) for (s, p), k in itertools.product(parts.items(), range(17))), reverse=True)[:17]
    assert got == {s: n for s in parts if (n := sum(x == s for _, x in best))}


def test_empty_table(spark):
    assert mix_sources(docs_frame(spark, []), Workspace(spark, "t")).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x")]
    got = mix_sources(docs_frame(spark, rows), Workspace(spark, "t")).collect()
    assert len(got) == 3 and all(r.taken <= 2 * r.size for r in got)


def test_rare_sources_get_their_targets_over_many_shards(spark):
    rows = [(i, "w " * 400, f"s{i % 3}") for i in range(12_000)]
    rows += [(50_000 + i, "v " * 20, "rare") for i in range(5)] + [(60_000 + i, "v " * 10, f"tail{i}") for i in range(40)]
    got = mix_sources(docs_frame(spark, rows), Workspace(spark, "t"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(sums) == 44
    for r in sums:
        assert abs(r.taken - r.target) <= 1, r
    assert got.where("taken > 2 * size OR taken < 0").count() == 0


def test_balance_carries_remainders(spark):
    frame = lambda target, tokens: spark.createDataFrame([(k, None, target, 3, t) for k, t in enumerate(tokens)], "s int, of string, target double, most_tokens long, tokens long")
    for target, tokens in ((10.0, [0] * 40), (119.6, [0, 3, 1, 2] * 10), (7.0, [3, 2] * 20), (0.2, [1, 0])):
        found = [r.tokens for r in balance(frame(target, tokens)).collect()]
        assert sum(found) == int(target + 0.5) and all(0 <= t <= 3 for t in found)
