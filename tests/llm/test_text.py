import random

import numpy as np
import pytest

from stratalog.llm import text as tx
from stratalog.llm.decontam import contamination, contamination_digest
from stratalog.llm.jaccard import similar_groups
from stratalog.llm.shared import Workspace
from stratalog.llm.substring import repeated_windows

from . import test_decontam, test_jaccard, test_substring
from .helpers import docs_frame


def twins(n):
    """Words of n bytes that any polynomial hash modulo a power of two confuses: Thue-Morse and its complement."""
    flags = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[f] for f in flags), "".join("ba"[f] for f in flags)


def test_hash_spans_tells_spans_apart():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 90))) for _ in range(4000)} | {w.encode() for n in (64, 65, 1024, 4096) for w in twins(n)}
    words = sorted(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    first, second = tx.hash_spans(data, start, end), tx.hash_spans(data, start, end, 1)
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(words)
    for k in rng.sample(range(len(words)), 40):
        own = np.frombuffer(words[k], np.uint8)
        assert tx.hash_spans(own, np.array([0]), np.array([len(own)])).tolist() == [first[k]]
    none = np.zeros(0, np.int64)
    assert len(tx.hash_spans(np.zeros(0, np.uint8), none, none)) == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_a_hash_trap_stay_apart(spark, n):
    a, b = twins(n)
    rest = [f"w{k}" for k in range(59)]
    rows = [(1, " ".join([a, *rest]), "s"), (2, " ".join([b, *[f"v{k}" for k in range(59)]]), "s"), (3, " ".join([b] * 60), "s"), (4, " ".join([a] * 60), "s"), (5, a, "s"), (6, b, "s")]
    docs = docs_frame(spark, rows)
    got = repeated_windows(docs, Workspace(spark, "t"), kept_text=True).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)) for r in got) == test_substring.brute(rows, 50)
    got = similar_groups(docs, Workspace(spark, "t"), 3, 90).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == test_jaccard.brute(rows, 3, 90)
    items = [(1, " ".join([a] * 12)), (2, b)]
    got = contamination_digest(contamination(docs, test_decontam.items_frame(spark, items))).collect()
    assert sorted(map(str, map(tuple, got))) == test_decontam.brute(rows, items)
