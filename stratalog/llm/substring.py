"""Substring dedup by fixed-block anchors: repeated word windows, found without moving a row for every window.

Any window of 2 * B words or more holds a whole block of B words that starts at a multiple of B in the document it is
compared with. So blocks at multiples of B are the index, every rolling window of B words is a probe, and only what lies
around a hit can be a repeat. Probes leave a task as sorted, delta-coded hash lists, a few bytes a word. Hits are then
extended: each window of ``width`` words around a hit is compared, by 88 bits of two independent fingerprints of all its
words, with all others, and runs of repeated windows make up the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import text as tx
from stratalog.llm.shared import Workspace

#: Bytes of text that are probed together.
CHUNK_BYTES = 4 << 20
#: Words for each bucket that one group of the exchange gets.
BUCKET_WORDS = 1 << 21
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max
SPANS = "array<struct<start:int,end:int>>"


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes, without the high planes that are all zero."""
    if not len(values):
        return bytes(9)
    values = np.ascontiguousarray(values, np.uint64)
    top = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :top].T
    return len(values).to_bytes(8, "little") + bytes([top]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> np.ndarray:
    n, top = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(blob[9:], decompressed_size=n * top, codec="zstd", asbytes=True)
        out[:, :top] = np.frombuffer(planes, np.uint8).reshape(top, n).T
    return out.view(np.uint64).reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


class Chunk:
    """Some whole documents: ids and the bytes of their texts."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.data, self.offsets = ids, data, offsets

    def packed(self) -> bytes:
        return pa.compress(self.data.tobytes(), codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, ids: bytes, offsets: bytes, body: bytes) -> Chunk:
        offsets = np.frombuffer(offsets, np.int64)
        size = int(offsets[-1])
        data = np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        return cls(np.frombuffer(ids, np.int64), data, offsets)

    def words(self) -> None:
        self.start, self.end, self.row = tx.split_words(self.data, self.offsets, tx.NOT_SPACE)
        self.hashes = tx.hash_spans(self.data, self.start, self.end)
        counts = np.bincount(self.row, minlength=len(self.ids))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts

    def seconds(self) -> np.ndarray:
        """A second fingerprint of every word, independent of ``hashes``."""
        return tx.hash_spans(self.data, self.start, self.end, 1)

    def some(self, rows: np.ndarray) -> Chunk:
        """The chunk's documents with the given numbers."""
        sizes = np.diff(self.offsets)[rows]
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        return Chunk(self.ids[rows], np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([[0], np.cumsum(sizes)]))

    def results(self, rows: np.ndarray, removed: np.ndarray, with_text: bool) -> Iterator[tuple]:
        """(id, words, removed spans, removed words, SHA-256 of the kept words, kept text) of documents."""
        step = np.zeros(len(self.data) + 2, np.int8)
        kept = ~removed
        last = self.end == self.offsets[1:][self.row]
        step[self.start[kept]] += 1
        step[(self.end + ~last)[kept]] -= 1
        mask = np.cumsum(step[: len(self.data)], dtype=np.int8) > 0
        body = np.where(tx.NOT_SPACE[self.data], self.data, 32).astype(np.uint8)[mask]
        bounds = np.concatenate([[0], np.cumsum(mask)])[self.offsets]
        for r in rows.tolist():
            text = body[bounds[r] : bounds[r + 1]].tobytes()
            text = text[:-1] if text[-1:] == b" " else text
            flags = removed[self.first[r] : self.first[r + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
            key = int(self.ids[r])
            yield (
                None if key == NO_ID else key,
                int(self.counts[r]),
                spans,
                int(flags.sum()),
                hashlib.sha256(text).hexdigest(),
                text.decode("utf-8", "replace") if with_text else None,
            )


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept_text", pa.string()),
    ]
)
RESULT_SQL = f"doc_id long, n_words long, spans {SPANS}, n_removed long, kept_sha256 string, kept_text string"
PACK_SQL = "chunk long, ids binary, offsets binary, body binary, n_words long"
PACK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary()), ("body", pa.binary()), ("n_words", pa.int64())])
LIST_SQL = "bucket long, chunk long, body binary"
LIST = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(key: str, text: str, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            ids = batch.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for low, high in tx.pieces(offsets, limit):
                part = Chunk(ids[low:high], data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n = len(tx.split_words(part.data, part.offsets, tx.NOT_SPACE)[0])
                yield _rows([(number, part.ids.tobytes(), part.offsets.tobytes(), part.packed(), n)], PACK)
                number += 1

    return run


def _probes(chunk: Chunk, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every rolling window of ``block`` words, and its place; windows that cross documents are left out."""
    at = np.flatnonzero(tx.within(chunk.row, block))
    return tx.windows(chunk.hashes, block)[at] >> np.uint64(64 - bits), at


def _buckets(values: np.ndarray, bits: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the sorted values' buckets: bucket numbers and the first place of each, with the end."""
    bucket = (values >> np.uint64(bits - spread)).astype(np.int64) if spread else np.zeros(len(values), np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[firsts], np.append(firsts, len(values))


def _probe(block: int, bits: int, spread: int):
    """Emits each chunk's distinct window hashes by bucket, flagged: an indexed block, seen in two documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, offsets, body in zip(*(batch.column(k).to_pylist() for k in ("chunk", "ids", "offsets", "body")), strict=True):
                chunk = Chunk.unpacked(ids, offsets, body)
                chunk.words()
                values, at = _probes(chunk, block, bits)
                if not len(values):
                    continue
                order = np.argsort(values)
                values, at = values[order], at[order]
                firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                owner = chunk.ids[chunk.row[at]]
                anchor = (at - chunk.first[chunk.row[at]]) % block == 0
                flags = np.logical_or.reduceat(anchor, firsts) + 2 * (np.minimum.reduceat(owner, firsts) != np.maximum.reduceat(owner, firsts))
                values = values[firsts]
                buckets, bounds = _buckets(values, bits, spread)
                tagged = (values << np.uint64(2)) | flags.astype(np.uint64)
                yield _rows(
                    [(int(b), number, squeeze_sorted(tagged[x:y])) for b, x, y in zip(buckets, bounds[:-1], bounds[1:], strict=True)], LIST
                )

    return run


def _seeds(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the hashes of its windows that equal an indexed block and occur in two documents."""
    lists = [unsqueeze_sorted(x) for x in table.column("body").to_pylist()]
    numbers = table.column("chunk").to_numpy()
    values = np.concatenate(lists)
    source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(values >> np.uint64(2), kind="stable")
    values, source = values[order], source[order]
    hashes, flags = values >> np.uint64(2), values & np.uint64(3)
    firsts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    sizes = np.diff(np.append(firsts, len(hashes)))
    either = np.bitwise_or.reduceat(flags, firsts)
    good = ((either & np.uint64(1)) > 0) & ((sizes > 1) | ((either & np.uint64(2)) > 0))
    keep = np.repeat(good, sizes)
    hashes, source = hashes[keep], source[keep]
    order = np.argsort(source, kind="stable")
    hashes, source = hashes[order], source[order]
    present, firsts = np.unique(source, return_index=True)
    bounds = np.append(firsts, len(source))
    bucket = table.column("bucket")[0].as_py()
    rows = [(bucket, int(numbers[s]), squeeze_sorted(hashes[x:y])) for s, x, y in zip(present, bounds[:-1], bounds[1:], strict=True)]
    return pa.Table.from_batches([_rows(rows, LIST)])


def _window_keys(chunk: Chunk, starts: np.ndarray, width: int, spread: int) -> tuple:
    """Distinct windows in order of fingerprint: key, check, smallest id; and each start's place among them."""
    keys = tx.windows(chunk.hashes, width)[starts]
    checks = tx.windows(chunk.seconds(), width)[starts] >> np.uint64(40)
    owner = chunk.ids[chunk.row[starts]]
    order = np.lexsort((owner, checks, keys))
    k, c = keys[order], checks[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    place = np.empty(len(starts), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], c[new], owner[order][new], place


def _extend(block: int, width: int, bits: int, spread: int, with_text: bool):
    """Parts each chunk: documents without candidates are done; others go on, with their candidate windows by bucket."""
    schema = pa.schema([*LIST, ("ids", pa.binary()), ("offsets", pa.binary()), ("mask", pa.binary()), *RESULT])
    blank = (None,) * len(RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("chunk", "ids", "offsets", "body", "seeds")
            for number, ids, offsets, body, seeds in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                chunk = Chunk.unpacked(ids, offsets, body)
                chunk.words()
                values, at = _probes(chunk, block, bits)
                wanted = np.concatenate([unsqueeze_sorted(x["body"]) for x in sorted(seeds or [], key=lambda x: x["bucket"])] or [np.zeros(0, np.uint64)])
                place = np.searchsorted(wanted, values)
                place[place == len(wanted)] = 0
                hit = wanted[place] == values if len(wanted) else np.zeros(len(values), bool)
                # A window of ``width`` words from p holds the blocks that start at p .. p + width - block.
                n = len(chunk.hashes)
                count = np.zeros(n + 1, np.int64)
                count[at[hit] + 1] = 1
                count = np.cumsum(count)
                p = np.flatnonzero(tx.within(chunk.row, width))
                p = p[count[p + width - block + 1] > count[p]]
                mask = np.zeros(n, bool)
                mask[p] = True
                going = np.unique(chunk.row[p])
                done = np.setdiff1d(np.arange(len(chunk.ids)), going)
                rows = [(None,) * 6 + r for r in chunk.results(done, np.zeros(n, bool), with_text)]
                if len(going):
                    rest = chunk.some(going)
                    bits_ = np.packbits(mask[np.isin(chunk.row, going)]).tobytes()
                    rows.append((None, number, rest.packed(), rest.ids.tobytes(), rest.offsets.tobytes(), bits_, *blank))
                    k, c, owner, _ = _window_keys(chunk, p, width, spread)
                    buckets, bounds = _buckets(k, 64, spread)
                    for b, x, y in zip(buckets, bounds[:-1], bounds[1:], strict=True):
                        parts = [squeeze_sorted(k[x:y]), squeeze(c[x:y]), squeeze(owner[x:y].view(np.uint64))]
                        blob = b"".join(len(q).to_bytes(8, "little") + q for q in parts)
                        rows.append((int(b), number, blob, None, None, None, *blank))
                yield _rows(rows, schema)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk a bit for each of its windows, set where a smaller id elsewhere has it."""
    keys, checks, owners = [], [], []
    for blob in table.column("body").to_pylist():
        parts, at = [], 0
        while at < len(blob):
            n = int.from_bytes(blob[at : at + 8], "little")
            parts.append(blob[at + 8 : at + 8 + n])
            at += 8 + n
        keys.append(unsqueeze_sorted(parts[0]))
        checks.append(unsqueeze(parts[1]))
        owners.append(unsqueeze(parts[2]).view(np.int64))
    sizes = [len(x) for x in keys]
    key, check, owner = np.concatenate(keys), np.concatenate(checks), np.concatenate(owners)
    order = np.lexsort((owner, check, key))
    k, c, o = key[order], check[order], owner[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    least = o[new][np.cumsum(new) - 1]
    beaten = np.empty(len(key), bool)
    beaten[order] = least < o
    bucket, rows = table.column("bucket")[0].as_py(), []
    for number, part in zip(table.column("chunk").to_pylist(), np.split(beaten, np.cumsum(sizes)[:-1]), strict=True):
        rows.append((bucket, number, len(part).to_bytes(8, "little") + np.packbits(part).tobytes()))
    return pa.Table.from_batches([_rows(rows, LIST)])


def _finish(width: int, spread: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("ids", "offsets", "body", "mask", "answers")
            for ids, offsets, body, mask, answers in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                chunk = Chunk.unpacked(ids, offsets, body)
                chunk.words()
                p = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(chunk.hashes)))
                _, _, owner, place = _window_keys(chunk, p, width, spread)
                parts = [x["body"] for x in sorted(answers, key=lambda x: x["bucket"])]
                beaten = np.concatenate([np.unpackbits(np.frombuffer(x[8:], np.uint8), count=int.from_bytes(x[:8], "little")) for x in parts]) > 0
                gone = p[beaten[place] | (owner[place] < chunk.ids[chunk.row[p]])]
                removed = tx.cover(len(chunk.hashes), gone, width)
                yield _rows(list(chunk.results(np.arange(len(chunk.ids)), removed, with_text)), RESULT)

    return run


def repeated_windows(
    docs: DataFrame,
    space: Workspace,
    width: int = 50,
    text: str = "text",
    key: str = "doc_id",
    kept_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, n_removed, kept_sha256, kept_text.

    Words are runs without white space, unchanged. A word is removed when a window of ``width`` consecutive words of its
    document covers it whose words, in order, also stand in a document with a smaller id; ``spans`` are the merged ranges
    of such words, ``kept_text`` (only if asked for) the others joined by single spaces. Windows are judged on the input.

    Null and empty texts have no words. A null id counts as larger than all others. Rows that repeat an id are judged
    each on its own and never against each other. Extra columns are ignored; an empty table gives no rows.

    Plan: texts are packed once into compressed chunks of whole documents. Probes and candidate windows move as hash
    lists, grouped into buckets of some two million words by hash, which equal texts don't unbalance: a chunk sends each
    distinct window once. Answers go back by chunk. Bucket count and hash width follow the number of words.
    """
    block = width // 2
    packs = space.write(docs.select(key, text).mapInArrow(_pack(key, text, CHUNK_BYTES), PACK_SQL), "packs")
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    bits = min(60, total.bit_length() + 12)
    spread = max(0, (total // BUCKET_WORDS).bit_length())
    probes = packs.mapInArrow(_probe(block, bits, spread), LIST_SQL)
    seeds = probes.groupBy("bucket").applyInArrow(_seeds, LIST_SQL)
    seeds = seeds.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("seeds"))
    extended = packs.join(seeds, "chunk", "left").mapInArrow(
        _extend(block, width, bits, spread, kept_text), f"{LIST_SQL}, ids binary, offsets binary, mask binary, {RESULT_SQL}"
    )
    extended = space.write(extended, "extended")
    space.drop("packs")
    answers = extended.where("bucket IS NOT NULL").select("bucket", "chunk", "body").groupBy("bucket").applyInArrow(_answers, LIST_SQL)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias("answers"))
    going = extended.where("ids IS NOT NULL").select("chunk", "ids", "offsets", "body", "mask")
    finished = going.join(answers, "chunk").mapInArrow(_finish(width, spread, kept_text), RESULT_SQL)
    done = extended.where("kept_sha256 IS NOT NULL").select(*RESULT.names)
    return done.unionByName(finished)
