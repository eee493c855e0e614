import math
import random

import numpy as np

from stratalog.llm.ordinal import fit, fit_on_labels, grade_documents, select_documents

from .helpers import docs_frame

BAD = ["vile", "trashy", "stupid"]


def fixture(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(800)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        kind = rng.choice(["good", "good", "good", "poor", "toxic"])
        if kind == "poor":
            w = [x + rng.choice(["***", "###"]) for x in w] if rng.random() < 0.5 else [w[0]] * len(w)
        if kind == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(kind == "good"), int(kind == "toxic")))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = fixture(1, 1500)
    held, _ = fixture(2, 600)
    truth = {i: (q, t) for i, q, t in fixture(2, 600)[1]}
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_on_labels(docs_frame(spark, rows), frame)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in select_documents(grade_documents(docs_frame(spark, held), model)).collect()}
    right = sum(got[i].keep == (q == 1 and t == 0) for i, (q, t) in truth.items())
    assert right >= 0.93 * len(truth)
    assert sum(got[i].p_at_least_2 < 0.6 for i, (_, t) in truth.items() if t) >= 0.9 * sum(t for _, t in truth.values())
    assert all(abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-12 for r in got.values())


def test_fit_finds_the_maximum():
    rng = random.Random(4)
    grades, lists = [], []
    for _ in range(300):
        own = sorted(rng.sample(range(12), 4))
        score = sum((-1) ** f * f / 6 for f in own) + rng.gauss(0, 1)
        grades.append(0 if score < -1 else 1 if score < 0.5 else 2)
        lists.append(np.array(own, np.int32))
    model = fit(np.array(grades), lists)

    def loss(weights, cuts):
        total = 3e-4 * sum(w * w for w in weights)
        for g, own in zip(grades, lists, strict=True):
            tails = [1, *[1 / (1 + math.exp(c - sum(weights[f] for f in own))) for c in cuts], 0]
            total -= math.log(tails[g] - tails[g + 1]) / len(grades)
        return total

    best, cuts = [float(model.weights[f]) for f in range(12)], model.thresholds.tolist()
    least = loss(best, cuts)
    for f in range(12):
        for step in (-0.05, 0.05):
            assert loss([w + step * (k == f) for k, w in enumerate(best)], cuts) > least - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(best, [c + step * (j == k) for j, c in enumerate(cuts)]) > least - 1e-4


def test_repeated_ids_do_not_pass_the_bound(spark):
    rows = [(i % 4, f"text number {i}", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    assert fit_on_labels(docs_frame(spark, rows), labels, fit_rows=10).fitted == 10
    assert fit_on_labels(docs_frame(spark, rows[::-1]), labels, fit_rows=3).fitted == 3


def test_odd_rows_and_reruns(spark):
    rows, labels = fixture(3, 200)
    frame = spark.createDataFrame([*labels, (0, None, None), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, [*rows, (300, None, "s"), (301, "", "s"), (5, rows[5][1], "s"), (None, "x", "s")]).withColumnRenamed("key", "p_at_least_1")
    one = grade_documents(docs, fit_on_labels(docs, frame)).collect()
    two = grade_documents(docs.repartition(5), fit_on_labels(docs.repartition(5), frame)).collect()
    assert len(one) == len(rows) + 4
    assert sorted((str(r.doc_id), r.expected_grade) for r in one) == sorted((str(r.doc_id), r.expected_grade) for r in two)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert grade_documents(docs_frame(spark, []), fit_on_labels(docs, empty)).count() == 0
