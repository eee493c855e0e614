"""BPE encoding and decoding through a table of distinct words.

A tokenizer that never joins pieces across ASCII white space gives a text's ids as those of its words, one after another.
So texts are split into words in blocks of bounded size, each block with a list of its distinct words and, for each text,
the places of its words in that list. The lists of all blocks meet by the words' hash class, where every distinct word of
the corpus is encoded once; the ids go back to the blocks and are joined to the places. Words travel as parts of a block's
list (some ten thousand words in many rows), as a row for each word would be larger than the corpus. Texts are split
twice, for the lists and for the places, which costs less than to keep the places meanwhile; a stamp of each block's list
proves that both saw the same block.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import text as tx
from stratalog.llm.blocks import list_column, loosened, packed, squeezed, text_blocks, unpacked, words_of
from stratalog.llm.shared import Workspace

#: Text of a block, and text for whose words there is one group that encodes them.
BLOCK_BYTES, GROUP_BYTES = 1 << 22, 6_000_000
#: Classes of words by hash, whose ranges make the groups.
CLASS_BITS = 20
#: Words that the tokenizer's library gets at a time.
CALL = 20_000


def _packed_words(words: pa.LargeStringArray) -> bytes:
    """Words have no line ends, which so come between them."""
    return squeezed("\n".join(words.to_pylist()).encode())


def _unpacked_words(data: bytes) -> pa.LargeStringArray:
    text = loosened(data).decode()
    return pa.array(text.split("\n") if text else [], pa.large_string())


def _classes(words: pa.LargeStringArray) -> np.ndarray:
    data, offsets = tx.column_bytes(words)
    return (tx.hash_spans(data, offsets[:-1], offsets[1:]) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _coded(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.Table, np.ndarray, pa.LargeStringArray, np.ndarray, int]]:
    """Each block with its number, the offsets of its rows, its distinct words, the most frequent first, the words' places
    in these, and a stamp of the list."""
    task, turn = TaskContext.get().partitionId(), 0
    for block in text_blocks(batches, limit):
        words, offsets = words_of(block.column("text"))
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        listed = coded.dictionary.take(pa.array(order))
        data, ends = tx.column_bytes(listed)
        stamp = hashlib.blake2b(data[ends[0] : ends[-1]].tobytes() + np.diff(ends).tobytes(), digest_size=8).digest()
        yield (task << 32) + turn, block, offsets, listed, place[codes], int.from_bytes(stamp, "little", signed=True)
        turn += 1


def _places(limit: int) -> Callable:
    """One row for each block: its documents with their words' places."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, offsets, _, codes, stamp in _coded(batches, limit):
            one = np.array([0, block.num_rows])
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "stamp": pa.array([stamp], pa.int64()),
                    "doc_ids": list_column(one, block.column("doc_id").combine_chunks()),
                    "n_words": list_column(one, pa.array(np.diff(offsets), pa.int32())),
                    "codes": pa.array([packed(codes)], pa.binary()),
                }
            )

    return places


def _deal(groups: int, limit: int) -> Callable:
    """Each block's list of words, cut by ranges of classes into ``groups`` parts with the words' places."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, words, _, stamp in _coded(batches, limit):
            part = _classes(words) * groups >> CLASS_BITS
            order = np.argsort(part, kind="stable")
            part = part[order]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            mine = [order[a:b] for a, b in zip(begin, np.append(begin[1:], len(part)))]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array(np.full(len(begin), number), pa.int64()),
                    "stamp": pa.array(np.full(len(begin), stamp), pa.int64()),
                    "part": pa.array(part[begin], pa.int32()),
                    "words": pa.array([_packed_words(words.take(pa.array(x))) for x in mine], pa.binary()),
                    "places": pa.array([packed(np.diff(x, prepend=0)) for x in mine], pa.binary()),
                }
            )

    return deal


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    """The worker's tokenizer; one thread of its own for each task, as Spark has dealt the work."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


def _encode(path: str) -> Callable:
    """The ids of a group's words, each distinct word encoded once; a row for each part that came in."""

    def encode(group: pa.Table) -> pa.Table:
        lists = [_unpacked_words(x) for x in group.column("words").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        tokenizer, ids, sizes = _tokenizer(path), [], []
        for at in range(0, len(coded.dictionary), CALL):
            for found in tokenizer.encode_batch(coded.dictionary.slice(at, CALL).to_pylist(), add_special_tokens=False):
                sizes.append(len(found.ids))
                ids.extend(found.ids)
        found = _lists(np.array(sizes, np.int64), np.array(ids, np.int32)).take(coded.indices)
        size = np.asarray(found.value_lengths(), np.int64)
        start, flat, at = np.append(0, np.cumsum(size)), np.asarray(found.flatten()), np.append(0, np.cumsum([len(x) for x in lists]))
        return pa.table(
            {x: group.column(x) for x in ("block", "stamp", "part", "places")}
            | {
                "sizes": pa.array([packed(size[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                "ids": pa.array([packed(flat[start[a] : start[b]]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
            }
        )

    return encode


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes, dtype=np.int64)), pa.int64()), pa.array(values, pa.int32()))


def _join(block: pa.Table, parts: pa.Table) -> pa.Table:
    """A block's documents with their ids: those of its words, at the words' places."""
    if set(parts.column("stamp").to_pylist()) - set(block.column("stamp").to_pylist()):
        raise ValueError("the documents came in another order or with other texts when they were read again")
    none = [np.zeros(0, np.int32)]
    place = np.concatenate(none + [np.cumsum(unpacked(x)) for x in parts.column("places").to_pylist()])
    size = np.concatenate(none + [unpacked(x) for x in parts.column("sizes").to_pylist()])
    flat = np.concatenate(none + [unpacked(x) for x in parts.column("ids").to_pylist()])
    words = _lists(size, flat).take(pa.array(np.argsort(place)))
    codes = pa.array(unpacked(block.column("codes")[0].as_py()))
    upto = np.append(0, np.cumsum(np.asarray(words.value_lengths().take(codes)), dtype=np.int64))
    n_words = np.asarray(block.column("n_words").combine_chunks().flatten(), np.int64)
    doc_ids = block.column("doc_ids").combine_chunks().flatten()
    return pa.table({"doc_id": doc_ids, "ids": list_column(upto[np.append(0, np.cumsum(n_words))], words.take(codes).flatten())})


def encode_texts(docs: DataFrame, tokenizer: str, space: Workspace, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>)``, one row for each row.

    ``tokenizer`` is a file of the tokenizers library whose pieces never cross ASCII white space (word or byte-level BPE
    that drops it); every node must have it. Ids are those of the library without begin and end tokens; strings of special
    tokens in a text become these. Null and empty texts have none; repeated rows and null ids pass; other columns are left
    out. A block holds ``block_bytes`` of text (or one longer text), and comes together in one task with its words' ids.
    """
    docs = _rereadable(docs.select("doc_id", "text"), space)
    ids = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(max(1, math.ceil(size / group_bytes)), 1 << CLASS_BITS)
    dealt = docs.mapInArrow(_deal(groups, block_bytes), "block long, stamp long, part int, words binary, places binary")
    pieces = dealt.groupBy("part").applyInArrow(_encode(tokenizer), "block long, stamp long, part int, places binary, sizes binary, ids binary")
    pieces = space.write(pieces, "pieces")
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("stamp", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(ids)),
            T.StructField("n_words", T.ArrayType(T.IntegerType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    whole = T.StructType([T.StructField("doc_id", ids), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_places(block_bytes), schema).groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_join, whole)


def _rereadable(docs: DataFrame, space: Workspace) -> DataFrame:
    """``docs`` if it is read from files, which give the same blocks each time, or else written to some."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return space.write(docs, "docs")


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``(id, piece)`` of a tokenizer's vocabulary with its added tokens; its size is that of the file, whatever the corpus."""
    vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, piece) for piece, i in vocabulary.items()), "id int, piece string")


def decode_ids(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """``encoded`` with ``decoded``: the pieces of its ``ids``, joined by one space, as a tokenizer without decoder gives them.

    A join of ids to ``piece_table`` by place: the table comes to every task as one row, with each piece at its id, so that
    no id leaves its document. Ids that the table lacks decode to nothing, an empty list to the empty text.
    """
    every = pieces.agg(F.max("id").alias("last")).select(F.explode(F.expr("sequence(0, last)")).alias("id"))
    rows = F.sort_array(F.collect_list(F.struct("id", "piece")))
    placed = every.join(pieces, "id", "left").agg(F.transform(rows, lambda x: x["piece"]).alias("_pieces"))
    found = F.transform("ids", lambda i: F.get("_pieces", i))
    return encoded.crossJoin(F.broadcast(placed)).withColumn("decoded", F.array_join(found, " ")).drop("_pieces")
