"""N-gram Jaccard join: rare-first prefix filtering, with length, positional and suffix filters.

Documents are sets of word shingles. All sets share one order of shingles, rare ones first by corpus counts, and sets of
Jaccard similarity t must share a shingle among the first few of each: those prefixes are joined, and pairs that the
filters leave are verified once, on the whole sets.

Dense groups (thousands of near copies) would make that join quadratic. There the method is applied again to differences:
when a prefix shingle's list is long, one of its sets becomes a hub, and every other set of the list is replaced by its
symmetric difference with the hub. Differences keep all distances between sets, and two sets that are similar to each
other but not both similar to the hub must share a part of their differences, so the same prefix filter holds for those,
which are small and mostly unlike each other. So each list costs its length, not its square, and no link between two
components is lost. A long list is dealt by classes of sizes before: what a frequent shingle brings together by chance is
mostly too unlike in size to be similar, and needs no hub then.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm import text as tx
from stratalog.llm.components import connected_components
from stratalog.llm.shared import Workspace
from stratalog.llm.substring import NO_ID, squeeze, unsqueeze

#: Prefix lists with at most so many sets that are not near their hub are paired in full; others get a hub of their own.
FULL_LIST = 24
#: The same for lists of differences, which the filters thin out far more.
DEEP_LIST = 2048
#: Counters of the shared frequency table, a fixed size whatever the corpus; tasks get one byte of each.
COUNTERS_LOG2 = 23
SEGMENTS = 16
ELEMENT_BITS = 64
#: Differences are compared by how many shingles each has in so many parts of the hash space.
PARTS = 32
#: The suffix filter compares sets by a parity for each shingle or two, so many at least.
LEAST_BITS = 64
#: Documents in candidate pairs up to this number (8 bytes each) are told to the scan by broadcast, more by a join.
BROADCAST_IDS = 1_000_000
SALTS = 16
#: Whole sets and differences are worked on by so many bytes at once, postings made of them by so many rows.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 50_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit shingle) of each distinct shingle, sorted; a text of fewer than ``k`` words is one shingle."""
    data = tx.LOWER[data]
    start, end, row = tx.split_words(data, offsets, tx.NOT_SPACE)
    hashes = tx.hash_spans(data, start, end)
    at = np.flatnonzero(tx.within(row, k))
    rows, values = [row[at]], [tx.windows(hashes, k)[at]]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            values.append(tx.windows(hashes, n)[first[short]])
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])]) if len(rows) else np.zeros(0, bool)
    return rows[new], values[new]


def set_digests(rows: np.ndarray, values: np.ndarray, n_rows: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit fingerprint of each row's set; another ``seed`` gives an independent one."""
    sizes = np.bincount(rows, minlength=n_rows)
    mixed = tx.mix(tx.mix(values + np.uint64(seed) * np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    ends = np.cumsum(sizes)
    sums = total[ends] - total[ends - sizes]
    return sizes, tx.mix(sums ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def parities(rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Of each row's set, whether an even or odd number of shingles falls to each of so many bits.

    There are as many bits as the next power of two above the set's size. Where two sets differ in a bit they differ in a
    shingle at least.
    """
    wide = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, LEAST_BITS))).astype(np.int64)
    begin = np.append(0, np.cumsum(wide))
    bits = np.bincount(begin[rows] + (values & (wide[rows] - 1).astype(np.uint64)).astype(np.int64), minlength=begin[-1]) & 1
    blob = np.packbits(bits.astype(np.uint8))
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(blob)])


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits ``parities`` of two sets differ: a lower bound of how many shingles are in one of them only."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def counter(values: np.ndarray) -> np.ndarray:
    """The counter that each shingle falls to."""
    return (values >> np.uint64(ELEMENT_BITS - COUNTERS_LOG2)).astype(np.int64)


def rarity(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of shingles in the shared order, before ties."""
    return places[counter(values)]


def body(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.uint64).tobytes()


def unbody(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


DIGEST = pa.schema(
    [("id", pa.int64()), ("tie", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("proof", pa.int64()), ("bits", pa.binary()), ("segment", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())]
)
DIGEST_SQL = "id long, tie long, n int, node long, proof long, bits binary, segment int, salt int, counts binary"
PAIR_SQL = "ctx long, a long, b long, hub boolean"
PAIR = pa.schema([("ctx", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("hub", pa.bool_())])
POSTING = pa.schema([("ctx", pa.int64()), ("elem", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("near", pa.bool_())])
POSTING_SQL = "ctx long, elem long, node long, n int, pos int, near boolean"
#: Prefixes of differences also carry how many shingles the difference has in each part of the hash space: what the set
#: has beyond its hub, then what it lacks.
DEEP = pa.schema([*POSTING, ("parts", pa.list_(pa.int32()))])
DEEP_SQL = f"{POSTING_SQL}, parts array<int>"
SETS = pa.schema([("ctx", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("near", pa.bool_()), ("body", pa.binary()), ("lost", pa.binary())])
SETS_SQL = "ctx long, node long, n int, near boolean, body binary, lost binary"
VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), *SETS])
VERIFIED_SQL = f"a long, b long, linked boolean, {SETS_SQL}"


def _ids(batch: pa.RecordBatch, key: str) -> np.ndarray:
    return batch.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _digests(key: str, text: str, k: int, seed: int):
    """Size and fingerprint of every set, and at the end of a partition its counts of hashed shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << COUNTERS_LOG2, np.int32)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            ids, ties = _ids(batch, key), _ids(batch, "tie")
            for low, high in tx.pieces(offsets):
                rows, values = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
                np.add.at(counts, counter(values), 1)
                sizes, nodes = set_digests(rows, values, high - low, seed)
                proofs = set_digests(rows, values, high - low, -1 - seed & (1 << 32) - 1)[1]
                none = [None] * (high - low)
                yield _batch(DIGEST, ids[low:high], ties[low:high], sizes, tx.signed(nodes), tx.signed(proofs), parities(rows, values, sizes), none, none, none)
        salt = TaskContext.get().partitionId() >> 8
        parts = [squeeze(x.astype(np.uint64)) for x in np.split(counts, SEGMENTS)]
        yield _batch(DIGEST, *[[None] * SEGMENTS] * (len(DIGEST) - 3), range(SEGMENTS), [salt] * SEGMENTS, parts)

    return run


def _summed(table: pa.Table) -> np.ndarray:
    total = np.zeros((1 << COUNTERS_LOG2) // SEGMENTS, np.uint64)
    for blob in table.column("counts"):
        total += unsqueeze(blob.as_py())
    return total


def _segment(table: pa.Table, numbers: np.ndarray) -> pa.Table:
    return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int32()), "counts": pa.array([squeeze(numbers)], pa.binary())})


def _sum_counts(table: pa.Table) -> pa.Table:
    return _segment(table, _summed(table))


def _places(table: pa.Table) -> pa.Table:
    """Counts on a logarithmic scale, a byte each."""
    return _segment(table, np.minimum(255, 8 * np.log2(_summed(table) + 1.0)).astype(np.uint64))


def corpus_places(digests: DataFrame) -> np.ndarray:
    """The frequency table of the whole corpus: partial tables summed in two steps, a byte for each of 2**23 counters in the end."""
    parts = digests.where("segment IS NOT NULL").select("segment", "salt", "counts")
    once = parts.groupBy("segment", "salt").applyInArrow(_sum_counts, "segment int, counts binary")
    rows = once.groupBy("segment").applyInArrow(_places, "segment int, counts binary").orderBy("segment").collect()
    return np.concatenate([unsqueeze(r["counts"]).astype(np.uint8) for r in rows]) if rows else np.zeros(1 << COUNTERS_LOG2, np.uint8)


def _prefixes(places, text: str, k: int, percent: int, seed: int):
    """Rare-first prefixes of the distinct sets of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            seen = np.zeros(0, np.uint64)
            for low, high in tx.pieces(offsets):
                rows, values = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
                sizes, nodes = set_digests(rows, values, high - low, seed)
                fresh = np.zeros(high - low, bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                fresh &= ~np.isin(nodes, seen) & (sizes > 0)
                seen = np.union1d(seen, nodes)
                some = fresh[rows]
                rows, values = rows[some], values[some]
                order = np.argsort(rows * 256 + rarity(places.value, values), kind="stable")
                rows, values = rows[order], values[order]
                first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=high - low))])
                pos = np.arange(len(rows)) - first[rows]
                n = sizes[rows]
                keep = pos < n - (percent * n + 99) // 100 + 1
                m = int(keep.sum())
                yield _batch(POSTING, np.zeros(m, np.int64), tx.signed(values[keep]), tx.signed(nodes)[rows[keep]], n[keep], pos[keep], np.zeros(m, bool))

    return run


def _whole_sets(text: str, k: int, seed: int):
    """The sets of chosen documents, as differences with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets):
                rows, values = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k)
                sizes, nodes = set_digests(rows, values, high - low, seed)
                parts = [body(x) for x in np.split(values, np.cumsum(sizes)[:-1])]
                none = [None] * (high - low)
                yield _batch(SETS, np.zeros(high - low, np.int64), tx.signed(nodes), sizes, np.zeros(high - low, bool), parts, none)

    return run


def _slices(batch: pa.RecordBatch, *bodies: str) -> Iterator[pa.RecordBatch]:
    """``batch`` by ranges of rows whose ``bodies`` take some ``SLICE_BYTES``."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in bodies)
    for low, high in tx.pieces(np.append(0, np.cumsum(size)), SLICE_BYTES):
        yield batch.slice(low, high - low)


def _delta_prefixes(places, percent: int):
    """Prefixes of differences: what a set has beyond its hub first, by rarity, then what it lacks."""

    def postings(rows: list[tuple]) -> pa.RecordBatch:
        out, parts = zip(*((columns, counts) for *columns, counts in rows), strict=True)
        flat = np.repeat(np.stack(parts), [len(columns[1]) for columns in out], axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 2 * PARTS), pa.array(flat.reshape(-1)))
        return _batch(DEEP, *[np.concatenate(x) for x in zip(*out, strict=True)], lists)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in _slices(whole, "body")):
            rows, total = [], 0
            for ctx, node, n, near, blob, lost in zip(*(batch.column(f.name).to_pylist() for f in SETS), strict=True):
                values = unbody(blob)
                flags = np.unpackbits(np.frombuffer(lost, np.uint8), count=len(values))
                order = np.argsort(flags.astype(np.int64) * 256 + rarity(places.value, values), kind="stable")
                order = order[: (100 - percent) * n // percent + 1]
                m = len(order)
                parts = np.bincount((values % np.uint64(PARTS)).astype(np.int64) + PARTS * flags, minlength=2 * PARTS).astype(np.int32)
                rows.append((np.full(m, ctx), tx.signed(values[order]), np.full(m, node), np.full(m, n), np.arange(m), np.full(m, near), parts))
                total += m
                if total >= SLICE_ROWS:
                    yield postings(rows)
                    rows, total = [], 0
            if rows:
                yield postings(rows)

    return run


def _verify(percent: int):
    """Compares each pair's whole sets once: kept if similar, or if ``a`` is the hub of ``b``, then with the difference."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ctx", "a", "b", "hub", "n_a", "n_b", "body_a", "body_b", "lost_a", "lost_b")
        for batch in (x for whole in batches for x in _slices(whole, "body_a", "body_b")):
            rows = []
            for ctx, a, b, hub, n_a, n_b, left, right, lost_a, lost_b in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                x, y = unbody(left), unbody(right)
                both = np.concatenate([x, y])
                order = np.argsort(both, kind="stable")
                both = both[order]
                same = both[1:] == both[:-1]
                alone = ~(np.append(same, False) | np.concatenate([[False], same]))
                linked = int(alone.sum()) * (100 + percent) <= (100 - percent) * (n_a + n_b)
                if not hub:
                    if linked:
                        rows.append((a, b, True, ctx, b, n_b, True, None, None))
                    continue
                flag = np.ones(len(both), bool)
                flag[len(x) :] = False
                if lost_a is not None:
                    flag[: len(x)] = np.unpackbits(np.frombuffer(lost_a, np.uint8), count=len(x)) == 0
                    flag[len(x) :] = np.unpackbits(np.frombuffer(lost_b, np.uint8), count=len(y)) == 1
                rows.append((a, b, linked, ctx, b, n_b, linked, body(both[alone]), np.packbits(flag[order][alone]).tobytes()))
            yield _batch(VERIFIED, *(zip(*rows, strict=True) if rows else [[]] * len(VERIFIED)))

    return run


def _candidates(postings: DataFrame, space: Workspace, level: int, percent: int, full_list: int) -> DataFrame:
    """Distinct pairs (ctx, a, b, hub) of a level, from its prefix lists; differences also pass the suffix filter."""
    side = ["node", "n", "pos", "own", *(["parts"] if level else [])]
    # One shuffle and one order of the prefixes for all of it: copies of a set in other tasks' batches go, lists are counted.
    own = Window.partitionBy("ctx", "elem")
    once = postings.withColumn("last", F.lag("node").over(own.orderBy("node"))).where("last IS NULL OR last <> node").drop("last")
    lists = once.withColumns({"c": F.count("*").over(own), "far": F.count_if(~F.col("near")).over(own)}).where("c > 1 AND far > 0")
    met = space.write(lists.withColumn("long", F.col("far") > full_list).drop("c", "far"), f"lists{level}")
    # Similar sets are of one class of sizes or of neighbours, so a long list is dealt by classes: a set goes to its own class
    # and to the next, and of two that meet one is at home. What a frequent shingle brings together by chance falls apart.
    sized = met.where("long").withColumn("home", _size_class("n", percent))
    sized = sized.select("*", F.explode(F.array("home", F.col("home") + 1)).alias("class")).withColumn("own", F.col("home") == F.col("class")).drop("home", "long")
    here = Window.partitionBy("ctx", "elem", "class")
    sized = sized.withColumns({"c": F.count("*").over(here), "far": F.count_if(~F.col("near")).over(here), "owned": F.count_if("own").over(here)})
    sized = sized.where("c > 1 AND far > 0 AND owned > 0").withColumn("long", F.col("far") > full_list).drop("c", "far", "owned")
    sized = space.write(sized, f"classes{level}")
    # Two sets near the same hub are in one component already, so one of each pair is far.
    short = met.where("NOT long").drop("long").withColumns({"class": F.lit(-1), "own": F.lit(True)})
    short = short.unionByName(sized.where("NOT long").drop("long"))
    far = short.where("NOT near").select("ctx", "elem", "class", F.struct(*side).alias("x"))
    pairs = far.join(short.select("ctx", "elem", "class", "near", F.struct(*side).alias("y")), ["ctx", "elem", "class"])
    pairs = pairs.where(
        (F.col("near") | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.node") != F.col("y.node"))
        & (F.col("x.own") | F.col("y.own"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & ((F.col("x.pos") + F.col("y.pos")) * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
        & (_apart("x.parts", "y.parts") * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n")) if level else F.lit(True))
    ).select("ctx", F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(False).alias("hub"))
    # A long class's hub is the set that has the shingle foremost; only long ones are looked through for it.
    long = sized.where("long")
    hubs = long.groupBy("ctx", "elem", "class").agg(F.min(F.struct("pos", "node")).alias("best")).select("ctx", "elem", "class", F.col("best.node").alias("hub_node"))
    long = long.join(hubs, ["ctx", "elem", "class"]).where(F.col("node") != F.col("hub_node"))
    long = long.select("ctx", F.col("hub_node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hub"))
    return pairs.union(long).distinct()


def _size_class(n: str, percent: int) -> Column:
    """Classes of sizes, a little wider than similar sets can be apart."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(max(1.001 * math.log(100 / percent), 1e-6))).cast("int")


def _apart(a: str, b: str) -> Column:
    """A lower bound of how many shingles are in one of two sets only, from their counts by part."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)


def _suffix_filter(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose parities differ in more bits than similar sets have shingles apart."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("hub", "n_a", "n_b", "bits_a", "bits_b"))
            kept = [hub or bits_apart(x, y) * (100 + percent) <= (100 - percent) * (n_a + n_b) for hub, n_a, n_b, x, y in zip(*columns, strict=True)]
            yield batch.select(PAIR.names).filter(pa.array(kept, pa.bool_()))

    left = heads.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return met.mapInArrow(near, PAIR_SQL)


def similar_groups(
    docs: DataFrame,
    space: Workspace,
    words: int = 5,
    percent: int = 80,
    text: str = "text",
    key: str = "doc_id",
    full_list: int = FULL_LIST,
    deep_list: int = DEEP_LIST,
    broadcast_ids: int = BROADCAST_IDS,
    tie: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, tie, kept.

    A document's set holds the distinct shingles of ``words`` words (runs without white space, A-Z lower-cased) of its
    whole text; a shorter text is one shingle, a null or empty one has none and links with nothing. Two documents link
    when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id that links reach.

    ``kept`` marks one row of each component: that of the smallest id and then of the smallest ``tie``, a long column that
    tells rows of one id apart (without it, all rows of the smallest id stay). Rows without shingles stay.

    Equal sets are one node, whatever their number; a node's two independent fingerprints must agree, or all are made again
    from another seed. Rows that repeat an id are judged each on its own. A null id counts as larger than all others and
    comes out null. Very long texts are read whole, as any other. Extra columns are ignored; an empty table gives no rows.

    Plan: two scans make sizes, counts and prefixes; prefixes are dealt by shingle once, and only shingles of two sets or
    more go on. The suffix filter works on a
    bit or two for each shingle of a set; documents in the pairs that it leaves are read once more for their sets. Links and
    components are narrow tables. Nothing of the documents reaches the driver but a byte for each of the 2**23 summed counters.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"))
    seed = 0
    while True:
        digests = space.write(docs.mapInArrow(_digests("id", "text", words, seed), DIGEST_SQL), f"digests{seed}")
        nodes = digests.where("segment IS NULL")
        heads = nodes.groupBy("node").agg(
            F.min(F.struct("id", "tie")).alias("head"),
            F.first("n").alias("n"),
            F.first("bits").alias("bits"),
            (F.min("proof") != F.max("proof")).alias("torn"),
        )
        heads = space.write(heads, f"heads{seed}")
        if not heads.where("torn").limit(1).count():
            break
        seed += 1
    places = space.spark.sparkContext.broadcast(corpus_places(digests))
    postings = docs.mapInArrow(_prefixes(places, "text", words, percent, seed), POSTING_SQL)
    links, level = [], 0
    while True:
        pairs = _candidates(postings, space, level, percent, full_list if level == 0 else deep_list)
        pairs = space.write(pairs if level else _suffix_filter(pairs, heads, percent), f"pairs{level}")
        for done in (f"lists{level}", f"classes{level}"):
            space.drop(done)
        if level == 0:
            wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            wanted = wanted.join(heads, "node").select(F.col("head.id").alias("id")).distinct()
            wanted = space.write(wanted, "wanted")
            wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted.hint("shuffle_hash")
            sets = docs.withColumn("id", F.coalesce("id", F.lit(NO_ID))).join(wanted, "id", "left_semi")
            sets = space.write(sets.select("text").mapInArrow(_whole_sets("text", words, seed), SETS_SQL), "sets")
        left = sets.select("ctx", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("body").alias("body_a"), F.col("lost").alias("lost_a"))
        right = sets.select("ctx", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("body").alias("body_b"), F.col("lost").alias("lost_b"))
        found = pairs.join(left.hint("merge"), ["ctx", "a"]).join(right.hint("merge"), ["ctx", "b"])
        found = space.write(found.mapInArrow(_verify(percent), VERIFIED_SQL), f"found{level}")
        for done in (f"pairs{level}", *(("sets", "wanted") if level == 0 else ())):
            space.drop(done)
        links.append(found.where("linked").select("a", "b"))
        sets = found.where("body IS NOT NULL").select(F.xxhash64("ctx", "a").alias("ctx"), "node", "n", "near", "body", "lost")
        sets = sets.dropDuplicates(["ctx", "node"])
        level += 1
        if not sets.limit(1).count():
            break
        postings = sets.mapInArrow(_delta_prefixes(places, percent), DEEP_SQL)
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    groups = connected_components(edges, space)
    for k in range(level):
        space.drop(f"found{k}")
    # Only linked nodes have a leader other than their own head.
    linked = groups.union(groups.select(F.col("component").alias("node"), "component").distinct()).join(heads.select("node", "head"), "node")
    leaders = linked.groupBy("component").agg(F.min("head").alias("leader"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    linked = linked.join(leaders.withColumn("salt", salts), ["component", "salt"]).select("node", "leader")
    named = space.write(heads.join(linked, "node", "left").select("node", F.coalesce("leader", "head").alias("leader")), "named")
    # Rows of one node are dealt by their place in the table, whatever their ids.
    rows = nodes.select("id", "tie", "n", "node", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(named.withColumn("salt", salts), ["node", "salt"])
    none = F.col("n") == 0
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.when(none, F.col("id")).otherwise(F.col("leader.id")), F.lit(NO_ID)).alias("component_id"),
        "tie",
        (none | ((F.col("leader.id") == F.col("id")) & (F.col("leader.tie") == F.col("tie")))).alias("kept"),
    )
