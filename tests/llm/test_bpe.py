"""Ids and texts against the tokenizers library."""

import os
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stratalog.llm import bpe
from stratalog.llm.shared import Workspace
from tests.llm.helpers import docs_frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["hello", "can't", "WÖRLD", "don", "'re", "<|endoftext|>", "<|startoftext|>x", "é", "　", " ", "ΣΑΣ", "İ", "12", "a\x1cb", "\u0085", "漢字", "🙂", "'", "...", "<|ENDOFTEXT|>", "\u0000"]


def run(spark, docs, name, *sizes):
    found = bpe.decode_ids(bpe.encode_texts(docs, PATH, Workspace(spark, name), *sizes), bpe.piece_table(spark, PATH))
    return [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in found.collect()]


def by_library(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((i, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("block, group", [(1 << 22, 6_000_000), (300, 200)])
def test_against_the_library(spark, block, group):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice([" ", "", "\n", "\t  ", "\x0b"]) for _ in range(rng.randrange(40))), "s") for i in range(80)]
    rows += [(100, None, "s"), (101, "", "s"), (102, " \n ", "s"), (None, "x y", "s"), (5, rows[5][1], "s"), (103, "abc" * 20_000, "s")]
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    assert sorted(run(spark, docs_frame(spark, rows), "bpe", block, group), key=key) == sorted(by_library(rows), key=key)


def test_words_are_encoded_once_for_many_blocks(spark, tmp_path):
    rows = [(i, f"the same words again and number{i % 3}", "s") for i in range(400)]
    docs_frame(spark, rows).repartition(7).write.parquet(str(tmp_path / "d"))
    found = run(spark, spark.read.parquet(str(tmp_path / "d")), "bpe2")
    assert sorted(found) == sorted(by_library(rows))
    parts = Workspace.opened[-1]
    each = spark.read.parquet(f"{parts.path}/pieces")
    assert each.select("block").distinct().count() > 1 and each.select("part").distinct().count() == 1


def test_texts_that_change_between_the_passes_are_refused(spark, monkeypatch):
    docs = docs_frame(spark, [(i, f"w{i}", "s") for i in range(20)])
    monkeypatch.setattr(bpe, "_rereadable", lambda docs, space: docs.withColumn("text", F.concat("text", F.unix_micros(F.current_timestamp()).cast("string"))))
    with pytest.raises(PythonException, match="another order"):
        run(spark, docs, "bpe3")


def test_no_documents(spark):
    assert run(spark, docs_frame(spark, []), "bpe4") == []
    clashing = docs_frame(spark, [(1, "a", "s")]).withColumns({"block": F.lit(1), "ids": F.lit(2), "part": F.lit(3), "_metadata": F.lit(4)})
    assert run(spark, clashing, "bpe5") == by_library([(1, "a", "s")])
    assert os.path.exists(PATH)
