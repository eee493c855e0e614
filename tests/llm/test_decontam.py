import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import decontam
from stratalog.llm.decontam import FmIndex, contamination, contamination_digest, suffix_order

from .helpers import docs_frame

FOLD = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(rows, items, width=10):
    out = []
    phrases = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1) if n else []:
            phrases.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    for d, t, _ in rows:
        w, hit, names = split(t), set(), set()
        for k in range(len(w)):
            for n in range(1, width + 1):
                if k + n <= len(w) and tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    names |= phrases[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(map(str, out))


def fixture(seed):
    rng = random.Random(seed)
    make = lambda n, k=6: " ".join(rng.choice(["Ab", "cé", "d9", "EE", "f", "Éa"][:k]) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, make(rng.randrange(8, 40))) for i in range(12)] + [(20, "ab cé d9"), (21, None), (22, "..."), (None, make(12)), (3, make(15))]
    rows = []
    for i in range(120):
        t = make(rng.randrange(0, 60))
        if rng.random() < 0.6:
            t += " " + (rng.choice(items)[1] or "") * rng.choice([1, 1, 3]) + " " + make(5)
        rows.append((i, t, "s"))
    return [*rows, (500, None, "s"), (501, "", "s"), (7, rows[7][1], "s"), (None, rows[8][1], "s")], items


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")


@pytest.mark.parametrize("shard, block", [(1 << 20, 1 << 20), (900, 120)])
def test_matches_brute_force(spark, monkeypatch, shard, block):
    rows, items = fixture(3)
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    docs = docs_frame(spark, rows).withColumn("n_words", F.lit("clash"))
    got = contamination_digest(contamination(docs, items_frame(spark, items), block_bytes=block)).collect()
    assert sorted(map(str, map(tuple, got))) == brute(rows, items)


def test_suffix_order_and_search():
    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(0, 4, 600) * (rng.random(600) < 0.9), 0)
    unique = np.where(symbols == 0, np.cumsum(symbols == 0) - 1000, symbols).tolist()
    assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=lambda p: unique[p:])
    index = FmIndex(symbols, 3)
    for phrase in ([1], [2, 3], [3, 1, 1], [1, 2, 3, 1]):
        alive, low, high = index.search(np.array([phrase]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(alive) else []
        assert got == [p for p in range(len(symbols)) if symbols[p : p + len(phrase)].tolist() == phrase]


def test_empty_tables(spark):
    rows, items = fixture(4)
    assert contamination(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    got = contamination_digest(contamination(docs_frame(spark, rows[:5]), items_frame(spark, []))).collect()
    assert [r.n_hit for r in got] == [0] * 5
