"""Runs by partition refinement against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stratalog.llm.periodic import periodic_runs, run_digest, runs_of, with_repeats
from tests.llm.helpers import docs_frame, words


def brute(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length, s = j - i + q, w[i : j + q]
            if j > i and length >= max(least, times * q) and not any(s[d:] == s[: length - d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least, times", [(1, 2), (6, 3), (24, 3)])
def test_runs_of_random_texts(seed, least, times):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(6)):
            n, k = rng.randrange(70), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        offsets = np.append(0, np.cumsum([len(w) for w in texts])).astype(np.int64)
        found = runs_of(np.array(sum(texts, []), np.int64), offsets, least, times)
        assert list(zip(*(x.tolist() for x in found))) == [(i, *r) for i, w in enumerate(texts) for r in brute(w, least, times)]


def _planted(doc_id, text):
    w = words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(90))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, " \t\n", None), (103, "ab " * 40, "s"), (103, "ab " * 40, "s"), (None, "x\x0by " * 30, "s"), (-7, "é ü " * 20, "s")]
    rows += [(200 + i, " ".join(str(k) for k in range(50)), "s") for i in range(80)]
    found = run_digest(periodic_runs(with_repeats(docs_frame(spark, rows)))).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    want = []
    for i, text, _ in rows:
        w = _planted(i, text)
        runs = brute(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        want.append((i, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)
    assert sum(x[1] > 0 for x in want) > 5


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "a " * 30_000, "s"), (2, " ".join(str(k % 7000) for k in range(22_000)), "s")]
    found = {r["doc_id"]: r for r in periodic_runs(docs_frame(spark, rows)).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 30_000, 1)] and found[1]["collapsed"] == "a"
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 22_000, 7000)] and len(found[2]["collapsed"].split()) == 7000
    assert run_digest(periodic_runs(with_repeats(docs_frame(spark, [])))).count() == 0
