"""WARC archives: writing records, and reading them back by boundary-chain verification.

An archive is uncompressed, so any byte range of it can be a task. Spark's text reader cuts a file at every occurrence of
the record magic, wherever file splits fall; each piece is a candidate record, whose Content-Length gives the offset of
its successor. A piece that starts in a payload is a candidate too. Which are records follows from the chain alone:
pointer jumping from the start of the file marks those that the chain reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.shared import Workspace

MAGIC = "WARC/1.0\r\n"
#: The alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Up to this many revisits, their targets are broadcast (16 bytes each); beyond, they are joined by shuffle.
BROADCAST_REVISITS = 500_000
SALTS = 64


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits make four letters."""
    digits = F.sha1(data)
    letter = lambda n, shift: F.substring(
        F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)
    )
    parts = []
    for k in range(8):
        n = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [letter(n, shift) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its bytes and digest; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload.cast("binary")).alias("digest")
    )


def write_archive(pages: DataFrame, space: Workspace, path: str, min_bytes: int = 0, broadcast_revisits: int = BROADCAST_REVISITS) -> None:
    """Writes a record per page to uncompressed WARC files in the folder ``path``, a file for each task.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a response and the
    others are revisits of it, which have no payload. Null ids count as larger than all others; pages that repeat the
    smallest id are all responses. Digests are found in a first scan and grouped narrow, so payloads never move while the
    repeated digests are few. Other columns than page_id, url and html are ignored, whatever their names; equal urls are
    records of their own; an empty table writes files without records. A very long payload is one record in one task.
    """
    rows = with_payload(pages)
    narrow = space.write(rows.select("page_id", "bytes", "digest"), "digests")
    repeated = (
        narrow.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    )
    targets = space.write(repeated.select("digest", "first_id"), "targets")
    if targets.count() <= broadcast_revisits:
        met = rows.join(F.broadcast(targets), "digest", "left")
    else:
        # Payloads that are not repeated are dealt by their digest; a repeated one by its page too, as it may be a third of all.
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("bytes") >= min_bytes)
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(uri != "", line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("first_id")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )
    # The writer's line end is the record's last byte.
    met.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "none").text(path)


HEADER_END = b"\r\n\r\n"
LENGTH = re.compile(rb"(?:^|\r\n)content-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", re.I)
CANDIDATE = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("whole", pa.bool_()),
        ("head", pa.string()), ("payload_bytes", pa.int64()), ("stated_bytes", pa.int64()), ("digest", pa.string()),
    ]
)
CANDIDATE_SQL = (
    "file string, split long, at long, size long, next long, whole boolean, head string, payload_bytes long, stated_bytes long, digest string"
)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, start (counted from the split's first piece) and bytes of each piece."""
    now, at = None, 0
    for batch in batches:
        for file, split, piece in zip(*(batch.column(k).to_pylist() for k in ("file", "split", "piece")), strict=True):
            if now != (file, split):
                now, at = (file, split), 0
            yield file, split, at, piece
            at += len(piece) + len(MAGIC)


def _measured(block: bytes) -> tuple[int, int | None, str]:
    """Bytes of an HTTP block's payload, the length that its header states, and the payload's digest."""
    end = block.find(HEADER_END)
    payload = block[end + 4 :] if end >= 0 else block
    stated = LENGTH.search(block[: max(end, 0)])
    return len(payload), int(stated[1]) if stated else None, base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: where its successor would start, and what its payload is if the piece holds all of it."""
    rows: list[tuple] = []
    for file, split, at, piece in _pieces(batches):
        end = piece.find(HEADER_END)
        length = LENGTH.search(piece[:end]) if end >= 0 else None
        step, whole, head, found = None, False, None, (None, None, None)
        if length:
            size = int(length[1])
            step, head = len(MAGIC) + end + 4 + size + 4, piece[:end].decode("utf-8", "replace")
            block = piece[end + 4 : end + 4 + size]
            whole = len(block) == size
            found = _measured(block) if whole else found
        rows.append((file, split, at, len(piece), step, whole, head, *found))
        if len(rows) == 4096:
            yield _table(rows, CANDIDATE)
            rows = []
    yield _table(rows, CANDIDATE)


RAW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())])


def _raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _pieces(batches):
        yield _table([row], RAW)


def scan_pieces(space: Workspace, path: str) -> DataFrame:
    """The pieces between magics with their file and file split, in file order within a split."""
    text = space.spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece")
    )


def split_bases(pieces: DataFrame) -> DataFrame:
    """(file, split) -> offset in the file of the split's first piece: running sums over the splits of a file."""
    sizes = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))


def reachable(candidates: DataFrame, space: Workspace) -> DataFrame:
    """(file, offset) of the candidates that the chain from the start of their file reaches, by pointer jumping.

    Each round the pointers leap twice as far and the reached part of the chain doubles, so the rounds are the logarithm
    of a file's records. A round is a pair of narrow tables in the shared folder.
    """
    known = candidates.select("file", "offset")
    jumps = candidates.where("next IS NOT NULL").join(known.withColumnRenamed("offset", "next").hint("merge"), ["file", "next"])
    jumps = space.write(jumps.select("file", "offset", "next"), "jumps0")
    reached = space.write(known.where("offset = 0"), "reached0")
    count, turn = reached.count(), 0
    while True:
        turn += 1
        more = reached.join(jumps.hint("merge"), ["file", "offset"]).select("file", F.col("next").alias("offset"))
        after = space.write(reached.union(more).distinct(), f"reached{turn}")
        now = after.count()
        space.drop(f"reached{turn - 1}")
        if now == count:
            space.drop(f"jumps{turn - 1}")
            return after
        second = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jumps = space.write(jumps.join(second.hint("merge"), ["file", "next"]).select("file", "offset", F.col("far").alias("next")), f"jumps{turn}")
        space.drop(f"jumps{turn - 1}")
        reached, count = after, now


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("payload_bytes", pa.int64()), ("stated_bytes", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        rows = []
        for file, owner, parts in zip(*(batch.column(k).to_pylist() for k in ("file", "owner", "parts")), strict=True):
            body = MAGIC.encode().join(p["piece"] for p in parts)
            end = body.find(HEADER_END)
            size = int(LENGTH.search(body[:end])[1])
            block = body[end + 4 : end + 4 + size]
            rows.append((file, owner, *(_measured(block) if len(block) == size else (None, None, None))))
        yield _table(rows, schema)


def torn_payloads(space: Workspace, pieces: DataFrame, placed: DataFrame, reached: DataFrame) -> DataFrame:
    """Payloads of records whose pieces don't hold them whole: the pieces up to the next record, read again and joined."""
    marked = placed.join(reached.withColumn("record", F.lit(True)).hint("merge"), ["file", "offset"], "left")
    until = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("record"), F.struct("offset", "whole")), ignorenulls=True).over(until)
    parts = marked.select("file", "split", "at", "offset", owner.alias("owner")).where("NOT owner.whole")
    raw = pieces.mapInArrow(_raw, "file string, split long, at long, piece binary")
    parts = raw.join(parts.select("file", "split", "at", "offset", F.col("owner.offset").alias("owner")), ["file", "split", "at"])
    parts = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    return parts.mapInArrow(_assemble, "file string, offset long, payload_bytes long, stated_bytes long, digest string")


def read_archive(space: Workspace, path: str) -> DataFrame:
    """One row per record of the WARC files in ``path``, with the length and digest of its whole payload.

    Columns: page_id, record_type, refers_to, uri, payload_bytes, payload_digest, intact, file, offset. Payloads may hold
    anything, the magic and whole records included: candidates off the chain are dropped, and a record that its payload's
    magics cut is joined again from its pieces. A response has the length and digest of the bytes read (``intact``: they
    are as its header states); a revisit those that its headers state. An empty folder of files gives no rows.
    """
    pieces = scan_pieces(space, path)
    found = space.write(pieces.mapInArrow(_candidates, CANDIDATE_SQL), "candidates")
    # A file's first piece is what stands before its first magic; any other piece starts behind its magic.
    offset = F.col("base") + F.col("at") - len(MAGIC)
    placed = found.join(split_bases(found), ["file", "split"]).where(offset >= 0)
    placed = space.write(placed.withColumn("offset", offset).withColumn("next", F.col("offset") + F.col("next")).drop("base"), "placed")
    reached = reachable(placed, space)
    records = placed.join(reached.hint("merge"), ["file", "offset"]).where("head IS NOT NULL")
    if records.where("NOT whole").limit(1).count():
        joined = torn_payloads(space, pieces, placed, reached)
        again = records.where("NOT whole").drop("payload_bytes", "stated_bytes", "digest").join(joined, ["file", "offset"], "left")
        records = records.where("whole").unionByName(again)
    head = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    page = lambda name: F.regexp_extract(head(name), "<urn:page:(.*)>", 1).try_cast("long")
    revisit, stated = head("WARC-Type") == "revisit", F.regexp_replace(head("WARC-Payload-Digest"), "^sha1:", "")
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        head("WARC-Type").alias("record_type"),
        F.when(revisit, page("WARC-Refers-To")).alias("refers_to"),
        head("WARC-Target-URI").alias("uri"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | (stated == F.col("digest"))).alias("intact"),
        "file",
        "offset",
    )
