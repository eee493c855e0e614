"""Frequent phrases and their collocation scores, by vertical lists of positions.

Documents are cut into blocks. A block has, for each word of a language, the list of the positions where it stands; between
pieces of text the numbering skips a position, so neighbours in number are neighbours in a piece. A phrase's list is
extended by merge-joining it with the lists of the words that stand right behind it, and the lengths of its lists in all
blocks add up to its exact frequency. Only phrases that are frequent in the whole corpus are extended, and only where the
phrase without its first word is frequent too, since no part of a frequent phrase is rare.

What moves between blocks is narrow: a block deals its extended lists by their phrases to ranges and sends each range one
row, the packed (phrase, next word, list length) that fall there. A range adds up the lengths from all blocks and answers
each with one row, the packed numbers of its frequent ones. Positions stay with their block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm import text as tx
from stratalog.llm.blocks import list_column, packed, text_blocks, unpacked
from stratalog.llm.shared import BROADCAST_ROWS, Workspace

BLOCK_BYTES = 3 << 21
#: Lists that a range has room for, some 100 bytes each while they are added up.
RANGE_LISTS = 1 << 21
#: Ranges at least, so that small corpora too are counted by several tasks.
LEAST_RANGES = 64
#: Bits of a phrase's number that tell it within its range.
WITHIN = 40
#: Characters that end a piece: ``[.,;:!?\x0A-\x0D]``.
ENDS = ~tx.byte_class([(0x0A, 0x0D), *((ord(x), ord(x)) for x in ".,;:!?")])
#: Bytes of words: what is neither an end nor a space nor a tab.
IN_WORD = tx.byte_class([(0x20, 0x20), (0x09, 0x0D), *((ord(x), ord(x)) for x in ".,;:!?")])
#: A block's lists of frequent words and of the phrases that are extended: numbers, lengths and positions, packed.
STATE = "block long, ids binary, sizes binary, positions binary, phrases binary, lengths binary, begins binary"
#: What a range tells: its frequent phrases, and for each block (null in those) the numbers of the lists that it sent.
TOLD = "block long, part int, numbers binary, id long, left long, right long, f long"


def _lists_of(key: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and the positions key by key in ascending order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.diff(np.append(begin, len(key))), positions[order]


def _one(values: pa.Array) -> pa.ListArray:
    return list_column(np.array([0, len(values)]), values)


def _listed(positions: np.ndarray) -> bytes:
    """Positions as their steps, compressed."""
    return packed(np.diff(positions, prepend=0))


def _numbers(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.int32)


def _post(limit: int) -> Callable:
    """The inverted lists of each block: language and word, and where it stands."""

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for block in text_blocks(batches, limit):
            data, offsets = tx.column_bytes(block.column("text"))
            data, offsets = tx.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
            start, end, row = (x.astype(np.int32) for x in tx.split_words(data, offsets, IN_WORD))
            ends = np.searchsorted(np.flatnonzero(ENDS[data]), start)
            apart = np.append(0, np.cumsum((ends[1:] != ends[:-1]) | (row[1:] != row[:-1])))[: len(start)]
            texts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(end - start, dtype=np.int64))), pa.py_buffer(data[IN_WORD[data]])]
            )
            words = texts.dictionary_encode()
            langs = pc.fill_null(block.column("lang"), "und").combine_chunks().dictionary_encode()
            lang = np.asarray(langs.indices, np.int64)[row]
            wide = len(words.dictionary)
            key, size, positions = _lists_of(lang * wide + np.asarray(words.indices, np.int64), np.arange(len(start)) + apart)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(task << 32) + turn], pa.int64()),
                    "langs": _one(langs.dictionary.take(pa.array(key // max(wide, 1))).cast(pa.string())),
                    "words": _one(words.dictionary.take(pa.array(key % max(wide, 1))).cast(pa.large_string()).cast(pa.string())),
                    "sizes": _one(pa.array(size, pa.int32())),
                    "lengths": pa.array([packed(size)], pa.binary()),
                    "positions": pa.array([_listed(positions)], pa.binary()),
                }
            )
            turn += 1

    return post


def _kept(lists: tuple[np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists (lengths, positions), those at the given places."""
    size, positions = lists
    flag = np.zeros(len(size), bool)
    flag[keep] = True
    return size[keep], positions[np.repeat(flag, size)]


NAMES = ("ids", "sizes", "positions", "phrases", "lengths", "begins")


def _marks(marks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    place, ids = np.asarray(marks.column("place")), np.asarray(marks.column("id"))
    order = np.argsort(place)
    return place[order], ids[order]


def _frequent_words(block: pa.Table, marks: pa.Table) -> pa.Table:
    place, ids = _marks(marks)
    if not block.num_rows:
        place = ids = place[:0]
        size = positions = np.zeros(0, np.int32)
    else:
        size = unpacked(block.column("lengths")[0].as_py())
        size, positions = _kept((size, _numbers(block.column("positions")[0].as_py())), place)
    none = np.zeros(0, np.int64)
    own = (packed(ids, "<i8"), packed(size), _listed(positions), packed(none, "<i8"), packed(none), _listed(none))
    return pa.table({"block": block.column("block")} | {x: pa.array([v], pa.binary()) for x, v in zip(NAMES, own)})


def _extended(row: dict, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of ``words`` words, merged with the words behind them: (phrase, next word, list lengths, positions)."""
    ids, size, at = row["ids"], row["sizes"], row["positions"]
    phrases, length, begin = (ids, size, at) if words == 1 else (row["phrases"], row["lengths"], row["begins"])
    if not len(begin):
        return phrases[:0], ids[:0], size[:0], begin
    behind = np.full(int(at.max()) + words + 2, -1, np.int32)
    behind[at] = np.repeat(np.arange(len(ids)), size)
    frequent = np.zeros(len(behind), bool)
    frequent[begin] = True
    next_word = behind[begin + words]
    good = (next_word >= 0) & frequent[begin + 1]
    key = np.repeat(np.arange(len(phrases)), length)[good] * np.int64(len(ids)) + next_word[good]
    key, size, positions = _lists_of(key, begin[good])
    return phrases[key // len(ids)], ids[key % len(ids)], size, positions


def _row_of(batch: pa.RecordBatch | pa.Table, row: int) -> dict:
    data = {x: batch.column(x)[row].as_py() for x in NAMES}
    read = {"ids": lambda x: unpacked(x, "<i8"), "phrases": lambda x: unpacked(x, "<i8"), "positions": _numbers, "begins": _numbers}
    return {x: read.get(x, unpacked)(data[x]) for x in NAMES}


def _dealt(left: np.ndarray, right: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists in order of their ranges, and where each range begins among them."""
    part = (tx.mix(tx.mix(left.view(np.uint64)) ^ right.view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=ranges)))


def _extensions(words: int, ranges: int) -> Callable:
    """(block, part, left, right, n): the extended lists of each block, packed in one row for each range that has some."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, size, _ = _extended(_row_of(batch, row), words)
                order, bounds = _dealt(left, right, ranges)
                left, right, size = left[order], right[order], size[order]
                parts = np.flatnonzero(np.diff(bounds))
                spans = [slice(bounds[x], bounds[x + 1]) for x in parts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array(np.full(len(parts), batch.column("block")[row].as_py()), pa.int64()),
                        "part": pa.array(parts, pa.int32()),
                        "left": pa.array([packed(left[x], "<i8") for x in spans], pa.binary()),
                        "right": pa.array([packed(right[x], "<i8") for x in spans], pa.binary()),
                        "n": pa.array([packed(size[x]) for x in spans], pa.binary()),
                    }
                )

    return extend


def _counted(least: int) -> Callable:
    """Adds up the lists of one range: its phrases of at least ``least`` occurrences, and their numbers for each block."""

    def count(key: tuple, sent: pa.Table) -> pa.Table:
        part = key[0].as_py()
        lists = {x: [unpacked(v.as_py(), kind) for v in sent.column(x)] for x, kind in (("left", "<i8"), ("right", "<i8"), ("n", "<i4"))}
        ends = np.cumsum([len(x) for x in lists["n"]])
        left, right, n = (np.concatenate(lists.pop(x)) for x in ("left", "right", "n"))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
        begin = np.flatnonzero(first)
        f = np.add.reduceat(n[order], begin, dtype=np.int64)
        good = np.flatnonzero(f >= least)
        # Within the range, from 1; 0 of a rare phrase.
        number = np.zeros(len(f), np.int32)
        number[good] = np.arange(1, len(good) + 1)
        numbers = np.empty(len(order), np.int32)
        numbers[order] = number[np.cumsum(first) - 1]
        told = {
            "block": pa.nulls(len(good), pa.int64()),
            "part": pa.nulls(len(good), pa.int32()),
            "numbers": pa.nulls(len(good), pa.binary()),
            "id": pa.array((part << WITHIN) + number[good].astype(np.int64), pa.int64()),
            "left": pa.array(left[begin[good]], pa.int64()),
            "right": pa.array(right[begin[good]], pa.int64()),
            "f": pa.array(f[good], pa.int64()),
        }
        answers = {
            "block": sent.column("block"),
            "part": pa.array(np.full(sent.num_rows, part), pa.int32()),
            "numbers": pa.array([packed(x) for x in np.split(numbers, ends[:-1])], pa.binary()),
        } | {x: pa.nulls(sent.num_rows, pa.int64()) for x in ("id", "left", "right", "f")}
        return pa.concat_tables([pa.table(told), pa.table(answers)])

    return count


def _frequent_phrases(words: int, ranges: int) -> Callable:
    def keep(block: pa.Table, answers: pa.Table) -> pa.Table:
        left, right, size, positions = _extended(_row_of(block, 0), words)
        order, bounds = _dealt(left, right, ranges)
        ids = np.zeros(len(order), np.int64)
        for part, numbers in zip(answers.column("part").to_pylist(), answers.column("numbers")):
            number = unpacked(numbers.as_py()).astype(np.int64)
            ids[order[bounds[part] : bounds[part + 1]]] = np.where(number > 0, (part << WITHIN) + number, 0)
        place = np.flatnonzero(ids)
        size, positions = _kept((size, positions), place)
        own = {"phrases": packed(ids[place], "<i8"), "lengths": packed(size), "begins": _listed(positions)}
        kept = {x: block.column(x) for x in ("block", "ids", "sizes", "positions")}
        return pa.table(kept | {x: pa.array([v], pa.binary()) for x, v in own.items()})

    return keep


def _small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """Tells a table of narrow rows to all tasks if it has few; a larger one meets the others by shuffle."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def frequent_phrases(
    docs: DataFrame,
    space: Workspace,
    least: int,
    longest: int,
    block_bytes: int = BLOCK_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
    range_lists: int = RANGE_LISTS,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that stand at least ``least`` times, and the words of each language.

    ``docs(text, lang)`` -> ``(lang, words array<string>, f)`` and ``(lang, n)``, n of all words, frequent or not.
    """
    lists = "block long, langs array<string>, words array<string>, sizes array<int>, lengths binary, positions binary"
    posted = space.write(docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_post(block_bytes), lists), "posted")
    each = posted.select("block", F.posexplode(F.arrays_zip("langs", "words", "sizes")).alias("place", "x"))
    each = each.select("block", "place", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.sizes").cast("long").alias("n"))
    counted = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = space.write(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    totals = space.write(each.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    marks = each.join(_small(words, broadcast_rows), ["lang", "word"]).select(F.col("block").alias("block"), "place", "id")
    by_block = posted.select("block", "lengths", "positions").groupBy("block")
    now = space.write(by_block.cogroup(marks.groupBy("block")).applyInArrow(_frequent_words, STATE), "lists1")
    space.drop("posted")
    named = words.select("id", "lang", F.array("word").alias("words"), "f")
    found, last, right = [named], words, words.select(F.col("id").alias("right"), "word")
    for size in range(1, longest):
        # A list has one occurrence at least, of a phrase that was counted as frequent.
        ranges = max(LEAST_RANGES, math.ceil((last.agg(F.sum("f")).first()[0] or 0) / range_lists))
        extended = now.mapInArrow(_extensions(size, ranges), "block long, part int, left binary, right binary, n binary")
        told = space.write(extended.groupBy("part").applyInArrow(_counted(least), TOLD), f"phrases{size + 1}")
        last = told.where(F.col("block").isNull()).select("id", "left", "right", "f")
        left = found[-1].select(F.col("id").alias("left"), "lang", "words")
        found.append(last.join(left, "left").join(right, "right").select("id", "lang", F.concat("words", F.array("word")).alias("words"), "f"))
        if size + 1 < longest:
            answers = told.where(F.col("block").isNotNull()).select("block", "part", "numbers")
            after = now.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_frequent_phrases(size, ranges), STATE)
            after = space.write(after, f"lists{size + 1}")
            space.drop(f"lists{size}")
            now = after
    space.drop(f"lists{longest - 1}")
    return space.write(reduce(DataFrame.union, (x.drop("id") for x in found)), "found"), totals


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame,
    space: Workspace,
    least: int = 30,
    longest: int = 4,
    share: int = 80,
    scale: int = 2_000_000,
    block_bytes: int = BLOCK_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
    range_lists: int = RANGE_LISTS,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words of ``docs(text, lang)``: ``(lang, phrase, words, a, l, r, n, score)``.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. All is
    counted for each lang (null: ``und``): ``n`` words, ``a`` occurrences of the phrase within pieces, at least ``least``.
    Cut after k words, a phrase has l and r occurrences of its two parts and the score ``floor(scale * a / (l + r))``; the
    lowest score counts, the smallest k of equal ones. Phrases that stand within a longer one of at most ``longest`` words
    are left out where that has ``share`` percent of their occurrences. Arithmetic is exact (decimals of 38 digits). Null
    and empty texts have no words; repeated rows count each; a block holds ``block_bytes`` of text or one longer text; up to
    ``broadcast_rows`` frequent words are told to all tasks, more meet blocks by shuffle; phrases are counted in ranges of
    some ``range_lists`` lists; other columns are left out; no rows without frequent phrases.
    """
    found, totals = frequent_phrases(docs, space, least, longest, block_bytes, broadcast_rows, range_lists)
    return scored(found, totals, share, scale)


def scored(found: DataFrame, totals: DataFrame, share: int, scale: int) -> DataFrame:
    """The collocations of ``frequent_phrases``."""
    size = F.size("words")
    candidates = found.where(size > 1).select("lang", "words", F.col("f").alias("a"))
    counts = found.select("lang", F.col("words").alias("part"), "f")
    first, rest = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, size)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    whole = lambda x: F.col(x).cast("decimal(19,0)")
    cuts = cuts.withColumn("product", whole("a") * F.lit(scale).cast("decimal(10,0)")).withColumn("parts", whole("l") + whole("r"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    lowest = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))"
    )
    longer = candidates.where(size > 2).select("lang", F.explode(inner).alias("words"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    covered = 100 * whole("longer") >= share * whole("a")
    kept = lowest.join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | ~covered)
    kept = kept.join(totals, "lang")
    return kept.select("lang", _phrase(F.col("words")).alias("phrase"), "words", "a", "cut.l", "cut.r", "n", "cut.score")


def best_collocations(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each lang by score and a, descending, and phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
