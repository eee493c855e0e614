"""Phrases and scores against counting every phrase."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalog.llm import collocations as cl
from stratalog.llm.shared import Workspace


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, id long, words string")


def brute(rows, least, longest=4, share=80, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if a < least or len(p) < 2:
            continue
        if any(b * 100 >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(mine[:top], 1)]
    return sorted(ranked)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "new york", "San Francisco bay area", "a", "é", "x\x1cy", "日本", "so so so so"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randrange(30)))
    return [(text(), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" .\n", "fr")]


@pytest.mark.parametrize("seed, least, block, told", [(1, 5, 1 << 22, 1000), (2, 3, 200, 0), (3, 12, 60, 1000)])
def test_against_counting(spark, seed, least, block, told):
    rows = rows_of(seed)
    docs = frame(spark, rows).repartition(3)
    found = cl.best_collocations(cl.collocations(docs, Workspace(spark, "cl"), least=least, block_bytes=block, broadcast_rows=told), top=40).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, least, top=40)


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", ["a", "b"], 8 * 10**18), ("en", ["a"], 9 * 10**18), ("en", ["b"], 8 * 10**18 + 1)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    row = cl.scored(found, totals, 80, 2_000_000).first()
    assert row["score"] == 2_000_000 * 8 * 10**18 // (17 * 10**18 + 1) and row["phrase"] == "a b"


def test_no_phrases(spark):
    none = frame(spark, [])
    assert cl.best_collocations(cl.collocations(none, Workspace(spark, "cl2"))).count() == 0
    few = frame(spark, [("a b c", "en")] * 3).withColumns({"block": F.lit(1), "sizes": F.lit(2)})
    assert cl.best_collocations(cl.collocations(few, Workspace(spark, "cl3"))).count() == 0
    assert cl.best_collocations(cl.collocations(few, Workspace(spark, "cl4"), least=3)).select("phrase", "a").collect() == [("a b c", 3)]


def test_a_long_text(spark):
    rows = [("up and down " * 20_000, "en"), ("up. and down", "en")]
    found = cl.best_collocations(cl.collocations(frame(spark, rows), Workspace(spark, "cl5"))).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 30)


class Kept(Workspace):
    """Keeps the tables that were written, with their plans."""

    def write(self, df, name):
        made = super().write(df, name)
        self.tables = getattr(self, "tables", {}) | {name: (df, made)}
        return made

    def drop(self, name=""):
        pass


def test_lists_do_not_meet_phrases_row_by_row(spark):
    space = Kept(spark, "cl6")
    rows = rows_of(4, 400)
    found = cl.best_collocations(cl.collocations(frame(spark, rows).repartition(3), space, least=3, block_bytes=300), top=40).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 3, top=40)
    for name in ("lists2", "lists3"):
        assert "Join" not in space.tables[name][0]._jdf.queryExecution().optimizedPlan().toString()
    blocks = space.tables["lists1"][1].count()
    assert blocks > 20
    for name in ("phrases2", "phrases3", "phrases4"):
        told = space.tables[name][1]
        answers = told.where(F.col("block").isNotNull())
        assert 0 < answers.count() <= blocks * cl.LEAST_RANGES and answers.select("block", "part").distinct().count() == answers.count()


@pytest.mark.parametrize("range_lists", [1, 40, 1 << 21])
def test_ranges_of_any_number(spark, range_lists):
    rows = rows_of(5, 60)
    found = cl.best_collocations(cl.collocations(frame(spark, rows).repartition(2), Workspace(spark, "cl7"), least=3, block_bytes=200, range_lists=range_lists), top=40)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 3, top=40)
