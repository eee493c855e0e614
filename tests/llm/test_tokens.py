import base64
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from stratalog.llm import tokens
from stratalog.llm.tokens import token_counts

from .helpers import docs_frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def fixture():
    rng = random.Random(9)
    odd = ["é", "日本", "\n", "\t", "  ", " ", "▁", "<s>", "</s>", "<0x0A>", "\x00", "ﬁ", "①", "　", "\xa0", "🙂", "!!", "***", "...", "ß", "Ä"]
    syllables = ["th", "er", "ing", "tion", "The", "un", "re", "ou", "a", "e", "I", "x", "qu", "1", "20", "http", "://", "ment", "ción", "schaft"]
    make = lambda n: "".join(rng.choice(rng.choice([odd, syllables, syllables, [" "]])) for _ in range(n))
    rows = [(i, make(rng.randrange(0, 200)), "s") for i in range(300)]
    rows += [(400, None, "s"), (401, "", "s"), (402, " ", "s"), (403, "a" * 20_000, "s"), (404, "日本語" * 3000, "s"), (405, "word " * 30_000, "s"), (406, "-" * 999, "s")]
    return [*rows, (7, rows[7][1], "s"), (None, "null id", "s")]


@pytest.mark.parametrize("unit, entries, chunk", [(1 << 17, 700_000, 48), (700, 4000, 20)])
def test_equals_the_library(spark, monkeypatch, unit, entries, chunk):
    model, rows = SentencePieceProcessor(model_file=PATH), fixture()
    want = sorted(str((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 500)) for i, t, _ in rows)
    if chunk == 48:
        got = token_counts(docs_frame(spark, rows), PATH, limit=500).collect()
        assert sorted(map(str, map(tuple, got))) == want
    for name, value in (("UNIT", unit), ("MOST_ENTRIES", entries), ("CHUNK", chunk), ("LEAD", chunk // 3)):
        monkeypatch.setattr(tokens, name, value)
    machine = tokens.Transducer(tokens.compiled(PATH).ranks)
    assert [counted(machine, [t or ""])[0] for _, t, _ in rows] == counted(machine, [t or "" for _, t, _ in rows]) == [len(model.encode(t or "")) for _, t, _ in rows]
    assert machine.entries() <= entries + 12 * unit
    for _, t, _ in rows[:200]:
        state, total = machine.first, machine.first_adds
        for c in t.replace(" ", "▁"):
            state, adds = machine.walk(state, c)
            total += adds
        assert total * bool(t) == len(model.encode(t))


def counted(machine, texts):
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    return machine.counts(np.concatenate(points), np.cumsum([0, *map(len, points)])).tolist()


def test_long_texts_without_spaces():
    rng = random.Random(2)
    model, machine = SentencePieceProcessor(model_file=PATH), tokens.Transducer(tokens.compiled(PATH).ranks)
    texts = ["a" * 300_000, "ab" * 60_000, "日本語" * 50_000, base64.b64encode(rng.randbytes(60_000)).decode(), "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(60_000))]
    assert counted(machine, texts) == [len(model.encode(t)) for t in texts]


def test_neighbours_match_brute_force():
    rng = random.Random(3)
    machine = tokens.compiled(PATH)
    pieces = list(machine.ranks)
    short = [p for p in pieces if len(p) <= 3]
    for k in range(20_000):
        left, right = rng.choice(short if k % 2 else pieces), rng.choice(short if k % 3 else pieces)
        left = right if k % 7 == 0 else left
        assert machine.neighbours(left, right) == (machine.pieces(left + right) == [left, right])


def test_what_neighbours_do_not_decide_is_left_to_the_library(monkeypatch):
    model, machine = SentencePieceProcessor(model_file=PATH), tokens.Transducer(tokens.compiled(PATH).ranks)
    walk = machine.walk

    def refuse(state, char):
        if char == "q":
            raise tokens.Unsure(char)
        return walk(state, char)

    monkeypatch.setattr(machine, "walk", refuse)
    texts = ["plain words", "a quick one", ""]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
    got = tokens._each(machine, PATH, np.concatenate(points), np.cumsum([0, *map(len, points)]))
    assert got.tolist() == [len(model.encode(t)) for t in texts]


def test_sample_table(spark):
    model = SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in token_counts(docs, PATH).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))


def test_empty_table(spark):
    assert token_counts(docs_frame(spark, []), PATH).count() == 0
