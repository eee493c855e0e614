"""Very long texts, whole, against brute force."""

import random

from stratalog.llm.decontam import contamination, contamination_digest
from stratalog.llm.exact import exact_groups
from stratalog.llm.jaccard import similar_groups
from stratalog.llm.mixing import mix_sources
from stratalog.llm.ordinal import fit_on_labels, grade_documents
from stratalog.llm.shared import Workspace
from stratalog.llm.substring import repeated_windows
from stratalog.llm.warc import read_archive, write_archive

from . import test_decontam, test_exact, test_jaccard, test_substring, test_warc
from .helpers import docs_frame, words


def texts():
    rng = random.Random(6)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    near = [w for k, w in enumerate(long) if k % 900]
    unbroken = "x" * 1_500_000
    return [(1, " ".join(long), "s"), (2, " ".join(near), "s"), (3, " ".join(long[-400:]), "t"), (4, unbroken, "t"), (5, unbroken, "s"), (6, "short one", None)]


def test_long_texts_in_every_operator(spark):
    rows = texts()
    docs = docs_frame(spark, rows)
    got = repeated_windows(docs, Workspace(spark, "t"), kept_text=True).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text)) for r in got) == test_substring.brute(rows, 50)
    got = similar_groups(docs, Workspace(spark, "t"), 3, 90).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == test_jaccard.brute(rows, 3, 90)
    items = [(1, " ".join(rows[0][1].split()[70_000:70_030])), (2, "x" * 1_500_000)]
    got = contamination_digest(contamination(docs, test_decontam.items_frame(spark, items))).collect()
    assert sorted(map(str, map(tuple, got))) == test_decontam.brute(rows, items)
    assert sorted(map(str, map(tuple, exact_groups(docs, Workspace(spark, "t")).collect()))) == test_exact.brute(rows)
    mixed = {r.doc_id: r for r in mix_sources(docs, Workspace(spark, "t")).collect()}
    assert {i: mixed[i].size for i, _, _ in rows} == {i: len(words(t)) for i, t, _ in rows}
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert grade_documents(docs, fit_on_labels(docs, labels)).where("p_at_least_1 BETWEEN 0 AND 1").count() == len(rows)


def test_a_long_payload(spark):
    pages = [(1, "u", "<p>" + "é WARC/1.0\r\n" * 90_000), (2, "u", "x"), (3, "u", "<p>" + "é WARC/1.0\r\n" * 90_000)]
    space = Workspace(spark, "t")
    write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), space, f"{space.path}/a")
    got = read_archive(space, f"{space.path}/a").collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == test_warc.brute(pages)
