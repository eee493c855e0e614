import random
from ast import literal_eval

import corpus_pipeline as cp
import pytest

from stratalog.llm import decontam
from stratalog.llm.shared import Workspace

from . import test_decontam, test_jaccard, test_mixing
from .helpers import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, n_words string, key string"
TOXIC = ["vile", "trashy", "stupid"]


def frame(spark, rows):
    """documents with clashing extra columns; the last one numbers the rows."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", "n", str(k)) for k, (i, t, s) in enumerate(rows)], SCHEMA)


def save(spark, path, rows, labels=(), items=()):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept(df):
    assert df.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    return sorted(int(r.key) for r in df.collect())


def least(i):
    return float("inf") if i is None else i


def brute_exact(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(t or "", []).append((-1 if i is None else i, k))
    return groups


def check_exact(rows, got):
    """Of each text one row stays, with the largest id."""
    for members in brute_exact(rows).values():
        stay = [m for m in members if m[1] in got]
        assert len(stay) == 1 and stay[0][0] == max(members)[0]


def check_near(rows, got):
    """Of each component of brute-force links one row stays, with the smallest id; rows without words all stay."""
    sets = [test_jaccard.shingles(t, 5) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    for members in groups.values():
        stay = [k for k in members if k in got]
        assert len(stay) == 1 and least(rows[stay[0]][0]) == min(least(rows[k][0]) for k in members)
    return len(groups)


ODD = [(7, "a text that stands alone here", "s"), (7, "dup", "s"), (9, "dup", "s"), (None, "dup", "s"), (9, "dup", "s"), (None, "only", "s"), (None, None, "s"), (3, "", "s"), (4, " \t", None)]


def test_exact_dedup_judges_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = ODD
    rows = rows + [(rng.randrange(40), f"text {rng.randrange(60)} " * rng.choice([1, 4000]), "s") for _ in range(200)]
    path = save(spark, tmp_path, rows)
    for docs in (frame(spark, rows), spark.read.parquet(f"{path}/documents.parquet")):
        got = kept(cp.exact_dedup(spark, docs, path))
        check_exact(rows, set(got))
        texts = [rows[k] for k in got]
        assert (7, "a text that stands alone here", "s") in texts and sum(t == "dup" for _, t, _ in texts) == 1


def test_near_dedup_judges_rows(spark):
    rows = ODD[:1] + [(7, "one two three four five six seven eight nine ten eleven", "s"), (7, "one two three four five six seven eight nine ten", "s"), (None, "one two three four five six seven eight nine ten", "s")]
    rows = rows + test_jaccard.fixture(17)[150:] + [(i % 30, t, s) for i, t, s in test_jaccard.fixture(17)[:60]]
    rows = [r for r in rows if words(r[1])]
    assert check_near(rows, set(kept(cp.near_dedup(spark, frame(spark, rows), "")))) < len(rows)
    blank = [(1, None, "s"), (1, "", "s"), (None, " ", "s")]
    assert kept(cp.near_dedup(spark, frame(spark, blank), "")) == [0, 1, 2]


def test_decontaminate_matches_brute_force(spark, tmp_path):
    rows, items = test_decontam.fixture(8)
    path = save(spark, tmp_path, rows, items=items)
    clean = {i for i, *_, hit in map(literal_eval, test_decontam.brute(rows, items)) if not hit}
    got = kept(cp.decontaminate(spark, frame(spark, rows), path))
    unique = [k for k, (i, _, _) in enumerate(rows) if sum(i == j for j, _, _ in rows) == 1]
    assert [k for k in got if k in unique] == [k for k in unique if rows[k][0] in clean]


def labelled(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(600)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(TOXIC))
        rows.append((i, " ".join(w), rng.choice(["a", "b", None])))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def test_quality_classifier(spark, tmp_path):
    rows, labels = labelled(2, 500)
    path = save(spark, tmp_path, rows, labels[:350])
    got = set(kept(cp.quality_classifier(spark, frame(spark, [*rows, (None, rows[0][1], "s"), (None, None, "s"), (1, "", "s"), (0, rows[0][1], "s")]), path)))
    right = [(k in got) == bool(labels[k][1]) for k in range(350, 500)]
    assert sum(right) >= 0.9 * len(right)
    assert (500 in got) == (0 in got) == (503 in got)


def test_without_labels_all_stay(spark, tmp_path):
    rows, _ = labelled(3, 20)
    path = save(spark, tmp_path, rows)
    assert kept(cp.quality_classifier(spark, frame(spark, rows), path)) == list(range(20))


@pytest.mark.parametrize("empty", [False, True])
def test_run_is_the_stages_in_order(spark, tmp_path, empty):
    rows, labels = labelled(5, 160)
    rows += [(1000 + i, rows[i % 9][1] + (" end" if i % 2 else ""), "a") for i in range(60)] + ODD
    items = [(1, " ".join(rows[11][1].split()[3:16])), (2, None)]
    rows = [] if empty else rows
    path = save(spark, tmp_path, rows, labels, items)
    opened = len(Workspace.opened)
    got = cp.run(spark, path)
    assert len(Workspace.opened) == opened + 1
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    left = rows
    good = set(kept(cp.quality_classifier(spark, frame(spark, rows), path)))
    left = [r for k, r in enumerate(left) if k in good]
    stay = {max(m)[1] for m in brute_exact(left).values()}
    left = [r for k, r in enumerate(left) if k in stay]
    near = set(kept(cp.near_dedup(spark, frame(spark, left), path)))
    check_near([r for r in left if words(r[1])], {j for j, k in enumerate(k for k, r in enumerate(left) if words(r[1])) if k in near})
    left = [r for k, r in enumerate(left) if k in near]
    hit = {i for i, *_, h in map(literal_eval, test_decontam.brute(left, items)) if h}
    left = [r for r in left if r[0] not in hit]
    found = got.collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(i) for i, _, _ in left)
    sizes = {}
    for _, t, s in left:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets = test_mixing.brute_targets(sizes) if left else {}
    for r in found:
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
    for s, want in targets.items():
        assert abs(sum(r.taken for r in found if r.source == s) - want) <= 1


def test_columns_of_any_name_pass(spark, tmp_path):
    """Every stage leaves columns alone that are called as its own ones, in any case."""
    rows = [(k, " ".join(f"w{(k // 2) * 40 + i}" for i in range(30)), "s") for k in range(12)]
    sf = save(spark, tmp_path / "sf", rows, [(k, 1, 0) for k in range(12)], [(1, rows[4][1])])
    names = ["_row", "_metadata", "_gone", "_at", "_spans", "_items", "hit_spans", "HIT_ITEMS", "keep", "P_at_least_1", "chunk", "node", "proof", "id", "tie", "size"]
    docs = cp.read_table(spark, sf, "documents").select("doc_id", "text", "source")
    for c in names:
        docs = docs.withColumn(c, cp.F.concat(cp.F.lit(c), "source"))
    docs.write.parquet(str(tmp_path / "named"))
    docs = spark.read.parquet(str(tmp_path / "named"))
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns, name
        found = left.collect()
        assert found and all(r[c] == f"{c}s" for r in found for c in names), name
    assert cp.mix(spark, docs, sf).count() == 12
    few = decontam.contamination(docs.drop("hit_spans", "HIT_ITEMS"), cp.read_table(spark, sf, "benchmark").union(spark.createDataFrame([(2, rows[6][1])], "item_id long, text string")), block_bytes=10)
    found = few.collect()
    assert sorted(r["doc_id"] for r in found if r["hit_spans"]) == [4, 5, 6, 7] and all(r["_spans"] == "_spanss" and r["_items"] == "_itemss" for r in found)
