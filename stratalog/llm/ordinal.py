"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import text as tx

#: Features are hashed to so many bits.
BITS = 18
#: The fit reads at most so many labelled documents: those whose ids hash lowest. A documented bound, not a cap on scoring.
FIT_ROWS = 6000
#: Pairs of document and feature that a step of the fit handles at once.
FIT_BLOCK = 1 << 18
#: A feature is used if so many of the fitted documents have it.
LEAST_DOCS = 4
#: Words count by their first bytes too, so that forms of a word share a feature.
STEMS = (5, 7)
PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
ADDED = ("expected_grade", "p_at_least_1", "p_at_least_2")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, sorted by row: hashed words and word starts, and hashed shapes of the whole text.

    Shapes are buckets of the number of words, of the shares of distinct words, of the commonest word and of capitals,
    and of how often each punctuation mark occurs.
    """
    n_rows = len(offsets) - 1
    low = tx.LOWER[data]
    start, end, row = tx.split_words(low, offsets, tx.ALNUM)
    hashes = tx.hash_spans(low, start, end)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    uses = np.diff(np.append(firsts, len(r)))
    r, h = r[firsts], h[firsts]
    words = np.bincount(row, minlength=n_rows)
    top = np.zeros(n_rows, np.int64)
    np.maximum.at(top, r, uses)
    sizes = np.diff(offsets)
    byte_row = np.repeat(np.arange(n_rows), sizes)
    histogram = np.bincount(byte_row * 256 + data, minlength=n_rows * 256).reshape(n_rows, 256)
    some = np.maximum(1, words)
    capitals = histogram[:, 65:91].sum(1)
    letters = np.maximum(1, capitals + histogram[:, 97:123].sum(1))
    shapes = [
        np.log2(words + 1.0).astype(np.int64),
        10 * np.bincount(r, minlength=n_rows) // some,
        10 * top // some,
        10 * capitals // letters,
    ]
    rows, values = [r], [h]
    for size in STEMS:
        long = end - start > size
        rows.append(row[long])
        values.append(tx.mix(tx.hash_spans(low, start[long], start[long] + size) + np.uint64(size)))
    for kind, value in enumerate(shapes):
        rows.append(np.arange(n_rows))
        values.append(tx.mix((value + 64 * (kind + 1)).astype(np.uint64)))
    for b in PUNCTUATION.tolist():
        has = np.flatnonzero(histogram[:, b])
        rows.append(has)
        values.append(tx.mix((np.log2(1 + 100 * histogram[has, b] / some[has]).astype(np.int64) + 64 * (b + 100)).astype(np.uint64)))
    key = np.unique((np.concatenate(rows) << BITS) | (np.concatenate(values) >> np.uint64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class OrdinalModel:
    """Shared weights with ordered thresholds: P(grade >= k) is the logistic of score - thresholds[k - 1]."""

    weights: np.ndarray
    thresholds: np.ndarray
    #: How many labelled documents it was fitted on.
    fitted: int = 0

    def tails(self, rows: np.ndarray, found: np.ndarray, n_rows: int) -> np.ndarray:
        score = np.bincount(rows, weights=self.weights[found], minlength=n_rows)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(grades: np.ndarray, lists: list[np.ndarray], n_grades: int = 3, rounds: int = 400, penalty: float = 6e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative logit model by Adam over the whole sample, with an L2 penalty."""
    counts = np.array([len(x) for x in lists], np.int64)
    found = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), counts)
    common = np.bincount(found, minlength=1 << BITS) >= LEAST_DOCS
    used = np.flatnonzero(common)
    number = np.cumsum(common, dtype=np.int32) - 1
    some = common[found]
    place, rows = number[found[some]], rows[some]
    del found, some
    blocks = [slice(k, k + FIT_BLOCK) for k in range(0, len(rows), FIT_BLOCK)]
    total = lambda at, weights, of, n: sum((np.bincount(at[b], weights=weights[of[b]], minlength=n) for b in blocks), np.zeros(n))
    share = [(np.sum(grades >= k) + 1) / (len(grades) + 2) for k in range(1, n_grades)]
    theta = -np.log(np.array(share) / (1 - np.array(share)))
    # Thresholds as a first one and logarithms of the steps, so that they stay in order.
    x = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.maximum(1e-2, np.diff(theta)))])
    m, v, n = np.zeros_like(x), np.zeros_like(x), max(1, len(grades))
    cuts = n_grades - 1
    for t in range(1, rounds + 1):
        score = total(rows, x, place, len(grades))
        steps = np.exp(x[len(used) + 1 :])
        theta = x[len(used)] + np.concatenate([[0], np.cumsum(steps)])
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30)))
        upper = np.concatenate([np.ones((len(grades), 1)), tail], 1)[np.arange(len(grades)), grades]
        lower = np.concatenate([tail, np.zeros((len(grades), 1))], 1)[np.arange(len(grades)), grades]
        p = np.maximum(1e-9, upper - lower)
        at_upper, at_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_score = -(at_upper - at_lower) / n
        g_theta = np.zeros(cuts)
        np.add.at(g_theta, np.maximum(0, grades - 1), np.where(grades > 0, at_upper, 0) / n)
        np.add.at(g_theta, np.minimum(cuts - 1, grades), np.where(grades < cuts, -at_lower, 0) / n)
        g = np.concatenate(
            [
                total(place, g_score, rows, len(used)) + penalty * x[: len(used)],
                [g_theta.sum()],
                np.cumsum(g_theta[::-1])[::-1][1:] * steps,
            ]
        )
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = x[: len(used)]
    return OrdinalModel(weights, x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1 :]))]), len(grades))


def _lists(text: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets):
                rows, found = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                lists = np.split(found.astype(np.int32), np.searchsorted(rows, np.arange(1, high - low)))
                kept = [k for k in batch.schema.names if k != text]
                columns = [batch.column(k).slice(low, high - low) for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in lists], pa.binary())], [*kept, "found"])

    return run


def fit_on_labels(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits grades 0 (toxic), 1 (poor) and 2 (good) on a bounded sample of the labelled documents.

    The sample is the ``fit_rows`` labelled ids of lowest hash, and no more rows than that where rows repeat an id; ties go
    by id and text. A document labelled more than once has its lowest grade; null labels count as 0 toxic and 0 quality.
    Without labels every document gets the prior and the model says that it is ``fitted`` on none. The driver gets the
    features of the sample, 4 bytes for each distinct one of a text.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.coalesce("quality", F.lit(0)) == 1, 2).otherwise(1)
    picked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select("grade", F.xxhash64("doc_id").alias("place"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    found = rows.mapInArrow(_lists("text"), "grade int, place long, doc_id long, tie long, found binary")
    sample = found.orderBy("place", "doc_id", "tie").limit(fit_rows).select("grade", "found").collect()
    return fit(np.array([r["grade"] for r in sample], np.int64), [np.frombuffer(r["found"], np.int32) for r in sample])


def _score(model, text: str, kept: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets):
                rows, found = features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                tails = model.value.tails(rows, found, high - low)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], [*kept, *ADDED]
                )

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade (0 to 2) and the tail probabilities p_at_least_1 and p_at_least_2.

    Whole texts are scored, in place and one to one, repeated rows included; null and empty texts get the score of a
    text without words. Columns of ``docs`` that bear one of the added names are replaced. No shuffle: the model's 2**18
    weights are broadcast, a fixed size.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    base = docs.select(*kept)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ADDED)])
    return base.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), text, kept), schema)


def select_documents(graded: DataFrame, least: float = 0.6, tail: str = "p_at_least_2") -> DataFrame:
    """Adds ``keep``: the tail probability is at least ``least``."""
    return graded.withColumn("keep", F.col(tail) >= least)
