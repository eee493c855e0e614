"""Runs: maximal stretches of words that repeat with a smallest period, by Crochemore's partition refinement.

Positions of a text form classes of equal factors. The classes of factors of one word are refined to two words, three and
so on: two positions stay together when the positions after them are together. A class is refined only by the classes that
split from another one in the stage before, and not by the largest part of each split (the smaller-half strategy), so a
position is touched O(log n) times. Members of a class are linked in order. Two neighbours at a distance equal to the
factors' length are a square, whose root is primitive, as a member would stand between them otherwise; squares of one
period at consecutive positions are one run.

All texts of a block are refined in step by numpy, each with classes of its own; a unique end mark after each text lets no
factor cross it. A link between neighbours is kept with the stage in which it began: when it ends, its distance tells
whether it was a square in between.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import text as tx
from stratalog.llm.blocks import joined, list_column, text_blocks, words_of


class _Links:
    """Neighbours of equal factors, the stage since which they are, and the squares that ended links were."""

    def __init__(self, order: np.ndarray, same: np.ndarray) -> None:
        n = len(order)
        self.after, self.before, self.born = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        self.after[order[:-1][same]], self.before[order[1:][same]] = order[1:][same], order[:-1][same]
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def end(self, at: np.ndarray, last: np.ndarray | int) -> None:
        """The links after ``at`` were neighbours up to stage ``last``."""
        gap = self.after[at] - at
        square = (self.after[at] >= 0) & (self.born[at] <= gap) & (gap <= last)
        if square.any():
            self.squares.append((at[square], gap[square]))

    def put(self, at: np.ndarray, after: np.ndarray, stage: int) -> None:
        """From ``stage`` on, ``after`` follows ``at`` (-1: nothing)."""
        new = self.after[at] != after
        at, after = at[new], after[new]
        self.end(at, stage - 1)
        self.after[at], self.born[at] = after, stage


def _walk(links: _Links, first: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    """All that follow ``first`` by ``step``, several lists in step."""
    found = []
    while len(first := first[first >= 0]):
        found.append(first)
        first = step[first]
    return found


def squares(codes: np.ndarray, offsets: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Primitive squares as (position, period), periods up to each text's limit; positions count an end mark after each text."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(texts), sizes + 1)
    n = len(text)
    marks = offsets[1:] + np.arange(texts)
    word = np.ones(n, bool)
    word[marks] = False
    symbol = np.zeros(n, np.int64)
    symbol[word] = codes + 1
    limit = limits[text]
    key = text * (int(codes.max(initial=0)) + 2) + symbol
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    group = np.append(0, np.cumsum(~same)) if n else np.zeros(0, np.int64)
    kind = np.empty(n, np.int64)
    kind[order] = group
    size = np.zeros(n + 1, np.int64)
    size[: len(np.bincount(group))] = np.bincount(group)
    links, used, small, stage = _Links(order, same), int(group[-1]) + 1 if n else 0, np.arange(n), 1
    while len(small):
        at = small[small > 0] - 1
        at = at[(limit[at] > stage) & (size[kind[at]] > 1)]
        if not len(at):
            break
        parent = kind[at]
        pair = parent * (n + 1) + kind[at + 1]
        by = np.argsort(pair, kind="stable")
        at, parent, pair = at[by], parent[by], pair[by]
        begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(np.append(begin, len(at)))
        part_of = parent[begin]
        first = np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1]))
        parts = np.diff(np.append(first, len(begin)))
        whole = part_of[first]
        rest = size[whole] - np.add.reduceat(count, first)
        split = (rest > 0) | (parts > 1)
        if not split.any():
            break
        most = np.maximum.reduceat(count, first)
        stage += 1
        # The chains of a class that leave it: what is left on both sides of one become neighbours.
        gone = np.flatnonzero(np.repeat(split & (rest > 0), parts).repeat(count))
        leave = gone[np.argsort(parent[gone] * n + at[gone])]
        walked: list[np.ndarray] = []
        if len(leave):
            leave, home = at[leave], parent[leave]
            linked = (links.after[leave[:-1]] == leave[1:]) & (home[:-1] == home[1:])
            heads, tails = leave[np.append(True, ~linked)], leave[np.append(~linked, True)]
            homes = home[np.append(True, ~linked)]
            left, right = links.before[heads], links.after[tails]
            links.put(left[left >= 0], right[left >= 0], stage)
            links.before[right[right >= 0]] = left[right >= 0]
            # What is left of a class is a small part where another part is larger.
            few = whole[split & (rest > 0) & (rest < most)]
            if len(few):
                one = np.append(True, homes[1:] != homes[:-1]) & np.isin(homes, few)
                walked = _walk(links, left[one], links.before) + _walk(links, right[one], links.after)
        within = np.append(pair[1:] == pair[:-1], False)
        there = split.repeat(parts).repeat(count)
        follows = np.where(within, np.append(at[1:], -1), -1)
        precedes = np.where(np.append(False, within[:-1]), np.append(-1, at[:-1]), -1)
        links.put(at[there], follows[there], stage)
        links.before[at[there]] = precedes[there]
        # The largest part isn't small, and keeps the class's number if no rest does.
        largest = np.zeros(len(begin), bool)
        top = np.flatnonzero(count == most.repeat(parts))
        largest[top[np.append(True, part_of[top][1:] != part_of[top][:-1])]] = True
        has_rest, broken = (rest > 0).repeat(parts), split.repeat(parts)
        fresh = broken & (has_rest | ~largest)
        number = np.where(fresh, used + np.cumsum(fresh) - 1, part_of)
        used += int(fresh.sum())
        size[whole] = np.where(split, np.where(rest > 0, rest, most), size[whole])
        size[number[fresh]] = count[fresh]
        kind[at] = number.repeat(count)
        keep = broken & ~(largest & (~has_rest | (count > rest.repeat(parts))))
        small = np.sort(np.concatenate([at[keep.repeat(count)], *walked]))
    every = np.arange(n)
    links.end(every, limit)
    if not links.squares:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in links.squares]), np.concatenate([x for _, x in links.squares])


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least ``least`` words and ``times`` (2 or more) periods, by text, start, period.

    ``codes`` are the words' numbers, of all texts one after another; ``offsets`` say where each text begins.
    """
    sizes = np.diff(offsets)
    at, period = squares(codes, offsets, np.where(sizes >= least, sizes // times, 0))
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    begin = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)))
    count = np.diff(np.append(begin, len(at)))
    at, period = at[begin], period[begin]
    length = count - 1 + 2 * period
    long = length >= np.maximum(least, times * period)
    at, period, length = at[long], period[long], length[long]
    base = offsets[:-1] + np.arange(len(sizes))
    text = np.searchsorted(base, at, "right") - 1
    start = at - base[text]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _runs_of_blocks(least: int, times: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            words, offsets = words_of(block.column("text"))
            codes = np.asarray(words.dictionary_encode().indices, np.int64)
            text, start, length, period = runs_of(codes, offsets, least, times)
            rest = ~tx.cover(len(words), offsets[text] + start + period, length - period)
            kept = np.append(0, np.cumsum(rest))[offsets]
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            each = np.searchsorted(text, np.arange(block.num_rows + 1))
            columns = {
                "doc_id": block.column("doc_id").combine_chunks(),
                "runs": list_column(each, values),
                "collapsed": joined(kept, words.filter(pa.array(rest))),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, runs array<struct<start,length,period>>, collapsed)``, one row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q (words q apart are identical), at
    least ``max(least, times * q)`` long, that no neighbouring word extends; runs come by start, then period. ``collapsed``
    has the words, joined by one space, without those that a run contains after its first q words. Null and empty texts
    have no runs and collapse to the empty text; repeated rows and null ids pass as they are; other columns are left out.
    One text is refined in one task, with some 100 bytes of memory for a word.
    """
    found = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("runs", found), T.StructField("collapsed", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(_runs_of_blocks(least, times), schema)


def with_repeats(docs: DataFrame, kept: int = 10) -> DataFrame:
    """``docs(doc_id, text)`` with a periodic end planted in each ``kept``-th text, chosen and shaped by the id's CRC-32.

    With h the CRC of the decimal id and g = h // ``kept``: where h is divisible by ``kept`` and the text has n > 0 words,
    each word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8). Other texts stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / kept).alias("g"))
    words = F.when(F.col("h") % kept == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")))
    docs = docs.withColumn("words", words).withColumn("n", F.nullif(F.size("words"), F.lit(0)).cast("long"))
    docs = docs.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))).otherwise(w))
    return docs.select("doc_id", F.when((F.col("h") % kept == 0) & (F.col("n") > 0), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``periodic_runs``, with the run of the greatest exact length / period (first by start, then period)."""
    shape = "struct<start:bigint,length:bigint,period:bigint>"
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(shape), better)
    line = lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
