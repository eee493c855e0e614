import hashlib
import random

import numpy as np
import pytest

from stratalog.llm import substring
from stratalog.llm.shared import Workspace
from stratalog.llm.substring import repeated_windows, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted

from .helpers import docs_frame, words


def brute(rows, width):
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t, _ in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            h = tuple(w[p : p + width])
            least[h] = min(least.get(h, key(i)), key(i))
    out = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < key(i):
                gone |= set(range(p, p + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(map(str, out))


def fixture(seed, width):
    rng = random.Random(seed)
    make = lambda n: rng.choice([" ", "\n", " \t "]).join(f"w{rng.randrange(400)}" for _ in range(n))
    passages = [make(n) for n in (width - 1, width, width + 1, 3 * width, 5 * width)]
    rows = []
    for i in range(150):
        parts = [make(rng.randrange(0, 2 * width))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            parts += [rng.choice(passages), make(rng.randrange(0, 9))]
        rows.append((i, " ".join(parts) + rng.choice(["", " ", "\n"]), "s"))
    rows += [(200 + i, passages[3], "s") for i in range(40)] + [(300, "é " * 4 * width, "s"), (301, "é " * 3 * width, "s")]
    return [*rows, (400, None, "s"), (401, "", "s"), (402, " \n", "s"), (5, rows[5][1], "s"), (None, passages[4], "s")]


@pytest.mark.parametrize("chunk, bucket, width", [(1 << 22, 1 << 21, 50), (700, 500, 20)])
def test_matches_brute_force(spark, monkeypatch, chunk, bucket, width):
    rows = fixture(2, width)
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring, "BUCKET_WORDS", bucket)
    docs = docs_frame(spark, rows).repartition(3)
    got = repeated_windows(docs, Workspace(spark, "t"), width, kept_text=True).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)) for r in got) == brute(rows, width)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_number_lists_round_trip():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.uint64), np.array([0], np.uint64), rng.integers(0, 1 << 63, 999).astype(np.uint64)):
        assert (unsqueeze(squeeze(x)) == x).all() and len(unsqueeze(squeeze(x))) == len(x)
        x = np.unique(x)
        assert (unsqueeze_sorted(squeeze_sorted(x)) == x).all()


def test_empty_table(spark):
    assert repeated_windows(docs_frame(spark, []), Workspace(spark, "t")).count() == 0
