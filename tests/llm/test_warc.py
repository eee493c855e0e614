import base64
import hashlib
import random

import pytest

from stratalog.llm.shared import Workspace
from stratalog.llm.warc import MAGIC, read_archive, write_archive


def brute(rows):
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", float("inf")), key(i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        response = key(i) == first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append(str((i, len(data), digest, "response" if response else "revisit", None if response else first[h or ""])))
    return sorted(out)


@pytest.mark.parametrize("split, limit", [("128m", 500_000), ("700b", 0)])
def test_round_trip(spark, split, limit):
    rng = random.Random(8)
    fake = f"{MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = ["", "é" * 50, "plain", f"a{MAGIC}", f"{MAGIC}Content-Length: 9999\r\n\r\n", fake, fake * 30, MAGIC * 9, "x" * 3000, "WARC/1.0\rWARC/1.0\r\n\nWARC/1.0\n", "\r\n\r\n" * 5]
    rows = [(i, rng.choice(["http://a/ b\r\nContent-Length: 1", "http://é/", None, "u"]), rng.choice([*bodies, f"own {i}"])) for i in range(200)]
    rows += [(900, "u", None), (7, rows[7][1], rows[7][2]), (None, "u", "never elsewhere"), (None, "u", "plain")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, digest int").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    space = Workspace(spark, "t")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        write_archive(pages, space, f"{space.path}/a", broadcast_revisits=limit)
        got = read_archive(space, f"{space.path}/a").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.intact for r in got)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows)


def test_files_are_warc(spark):
    space = Workspace(spark, "t")
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>")], "page_id long, url string, html string")
    write_archive(pages.coalesce(1), space, f"{space.path}/a")
    data = b"".join(r.content for r in spark.read.format("binaryFile").load(f"{space.path}/a").collect())
    at, types = 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        types.append(fields["WARC-Type"])
        at += len(head) + 4 + int(fields["Content-Length"]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert types == ["response", "revisit"]


def test_empty_table(spark):
    space = Workspace(spark, "t")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), space, f"{space.path}/a")
    assert read_archive(space, f"{space.path}/a").count() == 0
