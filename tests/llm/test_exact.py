import hashlib
import random

from pyspark.sql import functions as F

from stratalog.llm import exact
from stratalog.llm.exact import CHUNK_PATTERN, chunk_dictionary, chunk_recipes, exact_groups, recipe_groups
from stratalog.llm.shared import Workspace

from .helpers import docs_frame


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        best = max(ids) if ids else None
        out.append((i, best, len(g), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("ab. ,é\n") for _ in range(9000)) for _ in range(6)]
    rows = [(i, rng.choice([*long, "x", "", None, "y" * 5000, "y" * 5001]), "s") for i in range(300)]
    rows += [(7, "one", "s"), (7, "one", "s"), (None, "one", "s"), (None, "two", "s")]
    got = exact_groups(docs_frame(spark, rows), Workspace(spark, "t")).collect()
    assert sorted(map(str, map(tuple, got))) == brute(rows)


def test_chunks_cover_texts_and_follow_content(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcd. \n") for _ in range(30_000))
    frame = docs_frame(spark, [(1, text, "s"), (2, "An added start. " + text, "s")])
    found = {r.key: r.chunks for r in chunk_recipes(frame).collect()}
    assert sum(c.bytes for c in found[1]) == len(text)
    shared = {c.id for c in found[1]} & {c.id for c in found[2]}
    assert len(shared) > 0.7 * len(found[1])
    assert CHUNK_PATTERN
    words = chunk_dictionary(chunk_recipes(frame))
    assert words.where("NOT verified").count() == 0


def test_empty_table(spark):
    assert exact_groups(docs_frame(spark, []), Workspace(spark, "t")).count() == 0


def test_recipes_decide_and_hashes_confirm(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "h1", [1, 2]), (2, "h1", [1, 2]), (3, "h1", [2, 1]), (4, "h2", [2, 1]), (5, "h3", [])], "key long, text_sha256 string, recipe array<long>")
    got = {tuple(r.recipe): (r.group_size, r.keep_id, r.confirmed) for r in recipe_groups(rows).collect()}
    assert got == {(1, 2): (2, 2, True), (2, 1): (2, 4, False)}
    texts = [(1, "same", "s"), (2, "same", "s"), (3, "other", "s"), (4, "", "s")]
    recipes = chunk_recipes(docs_frame(spark, texts))
    monkeypatch.setattr(exact, "chunk_recipes", lambda *_: recipes.withColumn("chunks", F.slice("chunks", 1, 0)))
    assert sorted(map(str, map(tuple, exact_groups(docs_frame(spark, texts), Workspace(spark, "t")).collect()))) == brute(texts)


def test_no_groups_are_told_to_all_tasks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    plan = exact_groups(docs, Workspace(spark, "t"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
