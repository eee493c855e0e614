"""Benchmark decontamination with an FM-index for every shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import text as tx

#: Bytes of text in a shard: about a million words.
SHARD_BYTES = 6 << 20
#: Every so many positions the index keeps a suffix position.
SAMPLE = 8
#: Bytes of benchmark text whose phrases are broadcast at once; more go in further blocks.
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start:int,end:int>>"


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of ``symbols`` by prefix doubling; every 0 counts as a letter of its own, in order of place.

    The last symbol must be 0. Only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    breaks = np.flatnonzero(symbols == 0)
    rank = np.empty(n, np.int64)
    rank[breaks] = np.arange(len(breaks))
    open_ = np.flatnonzero(symbols)
    counts = np.bincount(symbols)
    counts[0] = len(breaks)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank[open_] = firsts[symbols[open_]]
    open_ = open_[counts[symbols[open_]] > 1]
    depth = 1
    while len(open_):
        key = rank[open_] * n + rank[open_ + depth]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        start_old = np.maximum.accumulate(np.where(new_old, at, 0))
        start_key = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[open_] = old + start_key - start_old
        alone = new_key & np.concatenate([new_key[1:], [True]])
        open_ = open_[~alone]
        depth *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class WaveletRanks:
    """Ranks in a sequence of small numbers: one bit plane for each binary digit, stably parted at every level."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before ``at``, element by element."""
        low, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            one = (value >> (self.levels - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low


class FmIndex:
    """FM-index of a shard's words: counts, a wavelet tree over the transform, sampled suffix positions."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        order = suffix_order(symbols)
        self.last = np.where(order > 0, symbols[order - 1], 0)
        self.known = np.zeros(len(symbols) + 1, np.int32)
        np.cumsum(self.last > 0, out=self.known[1:])
        self.tree = WaveletRanks(self.last[self.last > 0], max(1, int(alphabet).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # Rows whose walk would leave the known words are sampled too.
        self.sampled = (order % sample == 0) | (self.last == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, self.known[row].astype(np.int64))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases: those found, with their row ranges."""
        alive = np.arange(len(phrases))
        low, high = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -2, -1):
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if k < 0 or not len(alive):
                break
            symbol = phrases[alive, k]
            low, high = self.step(symbol, low), self.step(symbol, high)
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walks back to the nearest sampled row."""
        out = np.empty(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.positions[self.sample_at[rows[done]]] + walked
            todo, rows = todo[~done], rows[~done]
            rows = self.step(self.last[rows], rows)
            walked += 1
        return out


class Phrases:
    """Test phrases of some benchmark items: windows of ``width`` words; a shorter item is one phrase."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = tx.column_bytes(column)
        data = tx.LOWER[data]
        start, end, row = tx.split_words(data, offsets, tx.ALNUM)
        hashes = tx.hash_spans(data, start, end)
        self.vocabulary, firsts = np.unique(hashes, return_index=True)
        self.seconds = tx.hash_spans(data, start[firsts], end[firsts], 1)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        self.names = sorted({i for i, _ in items})
        name = {x: k for k, x in enumerate(self.names)}
        of_row = np.array([name[i] for i, _ in items], np.int64)
        counts = np.bincount(row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        first = np.concatenate([[0], np.cumsum(counts)])
        for k in range(len(items)):
            n = min(width, int(counts[k]))
            if n:
                own = symbols[first[k] : first[k + 1]]
                seen = np.lib.stride_tricks.sliding_window_view(own, n)
                found.setdefault(n, []).append((seen, np.full(len(seen), of_row[k])))
        for n, parts in sorted(found.items()):
            phrases, back = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([back.reshape(-1), np.concatenate([i for _, i in parts])]), axis=1)
            # Items of phrase p: pairs[1][begin[p]:begin[p + 1]].
            self.by_length.append((n, phrases, np.searchsorted(pairs[0], np.arange(len(phrases) + 1)), pairs[1]))


def _hits(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, whether an occurrence covers it, and distinct (row, item) pairs of a shard."""
    data = tx.LOWER[data]
    start, end, row = tx.split_words(data, offsets, tx.ALNUM)
    hashes = tx.hash_spans(data, start, end)
    place = np.searchsorted(phrases.vocabulary, hashes)
    place[place == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[place] == hashes if len(phrases.vocabulary) else np.zeros(len(hashes), bool)
    # A word of the benchmark has both of its fingerprints.
    at = np.flatnonzero(known)
    known[at] = phrases.seconds[place[at]] == tx.hash_spans(data, start[at], end[at], 1)
    symbols = np.where(known, place + 1, 0)
    # A break after each row, so that no phrase crosses rows.
    spread = np.zeros(len(symbols) + len(offsets) - 1, np.int64)
    spread[np.arange(len(symbols)) + row] = symbols
    nothing = np.zeros(0, np.int64)
    if not known.any():
        return row, np.zeros(len(row), bool), nothing, nothing
    index = FmIndex(spread, len(phrases.vocabulary))
    begins, sizes, rows, items = [], [], [], []
    row_end = np.cumsum(np.bincount(row, minlength=len(offsets) - 1) + 1)
    for n, wanted, first, owner in phrases.by_length:
        alive, low, high = index.search(wanted)
        count = high - low
        of = np.repeat(alive, count)
        at = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
        where = np.searchsorted(row_end, at, "right")
        begins.append(at - where)
        sizes.append(np.full(len(at), n))
        pair = np.unique(of * len(row_end) + where)
        of, where = pair // len(row_end), pair % len(row_end)
        uses = first[of + 1] - first[of]
        rows.append(np.repeat(where, uses))
        items.append(owner[np.repeat(first[of] - np.concatenate([[0], np.cumsum(uses)[:-1]]), uses) + np.arange(uses.sum())])
    hit = tx.cover(len(row), np.concatenate(begins), np.concatenate(sizes))
    pair = np.unique(np.concatenate(rows) * len(phrases.names) + np.concatenate(items))
    return row, hit, pair // len(phrases.names), pair % len(phrases.names)


def _search(shared, text: str, added: list[str]):
    """Adds words, merged spans and item names to the rows of Arrow batches, shard by shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        names = np.array(phrases.names, object)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets, SHARD_BYTES):
                part = data[offsets[low] : offsets[high]]
                row, hit, item_row, item = _hits(part, offsets[low : high + 1] - offsets[low], phrases)
                edge = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], row[1:] == row[:-1]])))
                stop = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([row[1:] == row[:-1], [False]]))) + 1
                counts = np.bincount(row, minlength=high - low)
                first = np.concatenate([[0], np.cumsum(counts)])
                base = first[row[edge]]
                span = pa.StructArray.from_arrays(
                    [pa.array((edge - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], ["start", "end"]
                )
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[edge], np.arange(high - low + 1)).astype(np.int32)), span)
                items = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(item_row, np.arange(high - low + 1)).astype(np.int32)), pa.array(names[item], pa.string())
                )
                out = batch.slice(low, high - low)
                kept = [k for k in out.schema.names if k not in added]
                columns = [out.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.astype(np.int64)), spans, items], [*kept, *added])

    return run


def phrase_blocks(benchmark: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Phrases of the benchmark in blocks of bounded bytes; a null text has no words, a null id is ''."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    for name, body in rows.toLocalIterator():
        if block and size + len(body) > block_bytes:
            yield Phrases(block, width)
            block, size = [], 0
        block.append((name, body))
        size += len(body)
    yield Phrases(block, width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (merged ranges of words inside a phrase) and hit_items (names, sorted).

    Words are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII. A phrase is ``width`` consecutive words
    of one item, or a whole shorter item. Every phrase is searched in every whole text: each task cuts its rows into
    shards, indexes a shard's words, searches all phrases backward, and locates and merges their occurrences.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; rows are kept one to one, in place,
    repeated rows included. Columns of ``docs`` that bear one of the added names are replaced.

    A text longer than a shard is a shard of its own, whole.

    Plan: no shuffle. Phrases are broadcast in blocks of ``block_bytes`` of benchmark text, so the driver and each task
    hold one block at a time (broadcasts wait on disk); a larger benchmark takes more passes over the same rows. A
    shard's index lives in one task and is rebuilt if that is lost.
    """
    added = ["n_words", "hit_spans", "hit_items"]
    base = docs.select(*[c for c in docs.columns if c not in added])
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T._parse_datatype_string(SPANS)), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*base.schema.fields, *kinds])
    found = None
    for block in phrase_blocks(benchmark, width, block_bytes):
        phrases = docs.sparkSession.sparkContext.broadcast(block)
        if found is None:
            found = base.mapInArrow(_search(phrases, text, added), schema)
            continue
        spans, items = (free_name(x, docs.columns) for x in ("_spans", "_items"))
        earlier = found.withColumnsRenamed({"hit_spans": spans, "hit_items": items}).drop("n_words")
        wide = T.StructType([*earlier.schema.fields, *kinds])
        found = earlier.mapInArrow(_search(phrases, text, added), wide)
        found = found.withColumn("hit_items", F.array_union(items, "hit_items")).withColumn("hit_spans", merged_spans(spans, "hit_spans"))
        found = found.select(*schema.names)
    return found.withColumn("hit_items", F.array_sort("hit_items"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with more underscores as long as a column bears it; names differ by more than case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def merged_spans(left: str, right: str):
    """Union of two lists of ranges as merged ranges."""
    both = F.array_sort(F.concat(left, right))
    grow = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(both, F.lit([]).cast(SPANS), grow)


def contamination_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The per-document digest of ``contamination``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
