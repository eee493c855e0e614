import json
import os

from pyspark.sql import functions as F

from stratalog.functions import geometry, identity, moments
from stratalog.operators import retention, rewind, scope, search
from stratalog.sources import journal as jr
from stratalog.sources.journal import JOURNAL
from stratalog.streaming import capture
from tests.test_rewind import event, journal, point, stamp, world


def test_write_read_and_replay(spark, tmp_path):
    rows, _ = world(3, 40)
    j = journal(spark, rows)
    jr.write_journal(j, str(tmp_path / "j"))
    back = jr.read_journal(spark, str(tmp_path / "j"))
    assert back.drop("source_bucket").exceptAll(j).count() == 0 and back.count() == 40
    assert jr.of_source(back, rows[0][2]).count() == 40
    broken = j.limit(5).withColumn("operation_type", F.lit("MERGE")).unionByName(j.limit(3)).unionByName(j.limit(1).withColumn("created_at", F.lit("2024-03-02T00:00:00+00:00")))
    good, bad = jr.split_valid(broken)
    assert (good.count(), bad.count()) == (4, 5)
    jr.write_pending(broken.drop("reason"), str(tmp_path / "p"))
    fresh, still = jr.replay_pending(spark, str(tmp_path / "p"), j)
    assert (fresh.count(), still.count()) == (1, 5)
    assert fresh.first()["event_id"] > 39


def test_migration_adds_columns_and_fingerprints(spark):
    old = spark.createDataFrame([(1, '{"fid": 3}'), (2, '{"fid": 3, "pk_field": "id", "pk_value": 8}')], "event_id long, feature_identity_json string")
    assert [r["entity_fingerprint"] for r in jr.migrate(old).orderBy("event_id").collect()] == ["fid:3", "pk:id=8"]


def test_stream_of_changes_reaches_the_journal(spark, tmp_path):
    rows = [
        ("ogr::/a", "ogr", "a", "1", "u", "s", stamp(1), "qt", None, {"v": "1"}, None, point(1)),
        ("ogr::/a", "ogr", "a", "1", "u", "s", stamp(2), "qt", {"v": "1", "updated_at": "1"}, {"v": "2", "updated_at": "2"}, point(1), point(1)),
        ("ogr::/a", "ogr", "a", "1", "u", "s", stamp(3), "restore", {"v": "2"}, {"v": "1"}, point(1), point(1)),
        ("ogr::/a", "ogr", "a", "1", "u", "s", stamp(4), "qt", {"v": "2"}, {"v": "2"}, point(1), point(1)),
        ("ogr::/a", "ogr", "a", "1", "u", "s", None, "qt", {"v": "2"}, None, point(1), None),
    ]
    spark.createDataFrame(rows, capture.CHANGES_DDL).write.parquet(str(tmp_path / "in"))
    stream = capture.events_of(capture.change_stream(spark, str(tmp_path / "in")))
    capture.journal_sink(stream, str(tmp_path / "j"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination(120)
    found = jr.read_journal(spark, str(tmp_path / "j")).orderBy("created_at").collect()
    assert [r["operation_type"] for r in found] == ["INSERT", "UPDATE"]
    assert json.loads(found[1]["attributes_json"]) == {"changed_only": {"v": {"old": 1, "new": 2}}}
    assert spark.read.json(str(tmp_path / "p")).count() == 1


def test_geometry(spark):
    import struct

    ring = [(0, 0), (4, 0), (4, 3), (0, 0)]
    def polygon(points, order="<"):
        return struct.pack(f"{order}BIII", order == "<", 3, 1, len(points)) + b"".join(struct.pack(f"{order}dd", *p) for p in points)
    turned = [(4, 3), (4, 0), (0, 0), (4, 3)]
    rows = [(1, polygon(ring)), (2, polygon(turned, ">")), (3, b"\x01\x63"), (4, None), (5, point(2))]
    df = spark.createDataFrame(rows, "n int, g binary").select("n", geometry.envelope("g").alias("e"))
    out = {r["n"]: r for r in df.collect()}
    assert tuple(out[1]["e"]) == (0, 0, 4, 3) == tuple(out[2]["e"])
    near, edge = [(x + 2e-10, y) for x, y in ring], [(x + 4.9e-9, y) for x, y in ring]
    pairs = [
        (polygon(ring), polygon(turned, ">"), True), (polygon(ring), polygon(near), True), (polygon(ring), polygon(edge), False), (point(2), point(2), True), (point(2), point(3), False),
        (polygon([(0, 0), (1e-10, 4), (4, 4), (0, 0)]), polygon([(1e-10, 0), (0, 4), (4, 4), (1e-10, 0)]), True), (None, None, True), (None, point(1), False), (b"x", b"x", True), (b"x", b"y", False),
        (polygon(ring), polygon([(0, 0), (4, 0), (4, 3), (2, 1), (0, 0)]), False),
    ]
    frame = spark.createDataFrame(pairs, "a binary, b binary, want boolean").select("want", geometry.same_shape(F.col("a"), F.col("b")).alias("got"))
    assert all(r["want"] == r["got"] for r in frame.collect())
    assert out[3]["e"] is None and out[4]["e"] is None and tuple(out[5]["e"]) == (2, 0, 2, 0)


def test_cutoff_spelling():
    assert moments.normalised_cutoff("2024-01-01T10:00:00+02:00") == "2024-01-01T08:00:00+00:00"
    assert moments.normalised_cutoff(" 2024-01-01 10:00:00Z ") == "2024-01-01 10:00:00+00:00"
    assert moments.normalised_cutoff("2024-01-01") == "2024-01-01"
    assert moments.normalised_cutoff("2024-01-01T10:00:00.000000+00:00") == "2024-01-01T10:00:00+00:00"
    assert [moments.normalised_cutoff(x) for x in ("", None, "tomorrow!!", 7)] == [None] * 4


def test_source_identity(spark):
    rows = [
        ("ogr", "/a/b.gpkg|subset=x|layername=l|LayerId=2", "ogr::/a/b.gpkg|layerid=2|layername=l"),
        ("postgres", "host=h dbname='d' table=\"t\"", "postgres::host=h port=5432 dbname=d schema=public table=t"),
        ("wfs", " http://x ", "wfs::http://x"),
    ]
    df = spark.createDataFrame(rows, "p string, u string, want string").select("want", identity.source_fingerprint("p", "u").alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    twice = df.select(identity.canonical_fingerprint("got").alias("a"), identity.canonical_fingerprint(identity.canonical_fingerprint("got")).alias("b"))
    assert all(r["a"] == r["b"] for r in twice.collect())
    assert spark.range(1).select(identity.without_password(F.lit("host=h password='a b' x=1"))).first()[0] == "host=h password=*** x=1"


def test_alias_guards(spark):
    edges = spark.createDataFrame([("a", "b", "", "")], "alias_fingerprint string, target_fingerprint string, created_at string, note string")
    more = scope.add_alias(edges, "b", "c", "now")
    assert {(r["alias"], r["target"]) for r in scope.final_targets(more).collect()} == {("a", "c"), ("b", "c")}
    for alias, target in (("a", "a"), ("b", "a")):
        try:
            scope.add_alias(edges, alias, target, "now")
        except ValueError:
            continue
        raise AssertionError(alias)


def test_excess_purge_keeps_whole_commits(spark):
    rows = [event(n, n, "INSERT", {"all_attributes": {}}, created=stamp(t)) for n, t in enumerate([1, 1, 1, 2, 2, 3])]
    j = journal(spark, rows)
    left = lambda most: sorted(r["event_id"] for r in retention.purge_excess(j, most).collect())
    assert left(2) == [3, 4, 5] and left(1) == [5] and left(4) == [3, 4, 5] and left(6) == left(0) == [0, 1, 2, 3, 4, 5]


def test_pairs_are_purged_until_none_is_left(spark):
    ops = {1: "INSERT", 2: "INSERT", 3: "DELETE", 4: "DELETE", 5: "UPDATE", 6: "INSERT"}
    j = journal(spark, [event(n, 1, op, {"all_attributes": {}}) for n, op in ops.items()])
    assert sorted(r["event_id"] for r in retention.purge_pairs(j).collect()) == [5, 6]
    assert retention.purge_pairs(j.where("event_id > 4")).count() == 2


def test_cut_windows_are_refused(spark):
    j = journal(spark, [event(n, n, "INSERT", {"all_attributes": {}}) for n in range(1, 6)])
    assert rewind.whole_window(j, 5).count() == 5 and rewind.whole_window(j, None).count() == 5
    try:
        rewind.whole_window(j, 4)
    except rewind.TruncatedWindow as e:
        assert "has 5" in str(e)
    else:
        raise AssertionError("a cut window was taken")


def test_a_journal_by_its_path(spark, tmp_path):
    own = jr.Journal(spark, jr.journal_path(str(tmp_path), "/home/me/town.project"))
    assert own.path.endswith("/town.journal") and jr.journal_path("/x").startswith("/x/unsaved-")
    rows = [event(n, n, "INSERT", {"all_attributes": {}}) for n in range(6)]
    own.append(journal(spark, rows[:4]))
    own.append(journal(spark, [*rows[4:], event(9, 9, "MOVE", {})]), pending=str(tmp_path / "p"))
    assert own.count(search.Criteria()) == 6 and own.event(3).count() == 1 and own.of_source(rows[0][2]).count() == 6
    assert [r["event_id"] for r in own.search(search.Criteria(), size=2).collect()] == [5, 4]
    assert own.users().count() == 1 and spark.read.json(str(tmp_path / "p")).count() == 1
    try:
        own.append(journal(spark, [event(9, 9, "MOVE", {})]))
    except ValueError as e:
        assert "bad operation_type" in str(e)
    else:
        raise AssertionError("an invalid event was written")
    jr.write_journal(own.events(), str(tmp_path / "q"), ordered=True)
    retention.compact(own.events(), str(tmp_path / "r"))
    assert jr.read_journal(spark, str(tmp_path / "r")).count() == jr.read_journal(spark, str(tmp_path / "q")).count() == 6


def test_appended_events_get_growing_ids(spark, tmp_path):
    from stratalog.session import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    rows = lambda a, b, given=None: spark.createDataFrame([event(n, n, "INSERT", {"all_attributes": {"v": n}}) for n in range(a, b)], JOURNAL).withColumn(
        "event_id", F.when(F.col("event_id") == (given if given is not None else -1), F.col("event_id"))
    )
    journal = jr.Journal(spark, str(tmp_path / "j"))
    assert journal.last_id() == 0
    journal.append(rows(0, 30).repartition(20))
    journal.append(rows(30, 60, given=50).repartition(7))
    journal.append(rows(60, 70))
    found = journal.events().select("event_id", "created_at").orderBy("event_id").collect()
    assert len({r[0] for r in found}) == 70 and found[0][0] == 1
    first, rest = [r for r in found if r[0] <= 30], [r for r in found if r[0] > 50]
    assert [r[1] for r in first] == sorted(r[1] for r in first) and len(first) == 30
    assert len(rest) == 39 and max(r[0] for r in rest) == 89
    assert set(os.listdir(shared_folder(spark))) == before


def test_batches_leave_no_tables_behind(spark, tmp_path):
    from stratalog.session import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    for n in range(5):
        events = spark.createDataFrame([event(k, k, "INSERT", {}) for k in range(4)], JOURNAL).withColumn("event_id", F.lit(None).cast("long"))
        capture.append_batch(events, n, str(tmp_path / "j"), str(tmp_path / "p"))
    assert jr.read_journal(spark, str(tmp_path / "j")).select("event_id").distinct().count() == 20
    assert set(os.listdir(shared_folder(spark))) == before
