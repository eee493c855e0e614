"""Small operators, each against values worked out by hand."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from stratalog.functions import geometry, identity, payload
from stratalog.operators import retention, search, stats, targets
from stratalog.streaming import capture, statistics
from tests.test_rewind import DS, event, journal, point, stamp


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_earlier_fingerprints(spark):
    uri = "dbname='d' host=h port=5433 table=\"s\".\"t\""
    old = lambda p, u: identity.earlier_fingerprint(F.lit(p), F.lit(u))
    file, other, odd = values(spark, old("ogr", "C:\\d\\a.gpkg |layername=l|subset=x"), old("memory", " Point?x "), old("postgres", uri))
    assert file == "ogr::C:/d/a.gpkg|layername=l|subset=x" and other == "memory::Point?x"
    assert odd.startswith("postgres::") and "dbname=d" in odd and "port=5433" in odd and "host=h" in odd
    forms = values(spark, identity.fingerprint_forms(F.lit("ogr"), F.lit("/d/a.gpkg|layername=l|subset=x")))[0]
    assert len(forms) == 2 and forms[1] == "ogr::/d/a.gpkg|layername=l|subset=x"


def test_layers_are_selected_by_any_form(spark):
    layers = spark.createDataFrame([("ogr", "/d/a.gpkg|layername=l|subset=x", 1), ("ogr", "/d/b.gpkg", 2)], "provider_type string, source_uri string, n int")
    pick = lambda *f: sorted(r["n"] for r in identity.selected(layers, spark.createDataFrame([(x,) for x in f], "fingerprint string")).collect())
    assert pick() == [1, 2] and pick("ogr::/d/b.gpkg") == [2] and pick("ogr::/x.gpkg") == []
    assert pick("ogr::/d/a.gpkg|layername=l|subset=x") == [1]


def test_admission_takes_equal_names(spark):
    rows = [event(1, 1, "INSERT", {}), event(2, 1, "INSERT", {}, ds="ogr::/other.gpkg")]
    j = journal(spark, rows)
    ids = lambda s: sorted(r["event_id"] for r in capture.admitted(j, s).collect())
    assert ids(None) == ids([]) == [1, 2] and ids([DS]) == [1] and ids(["ogr::/none.gpkg"]) == []


def test_texts_and_modes(spark):
    known, unknown = values(spark, stats.issue_text(F.lit("repeated_id")), stats.issue_text(F.lit("odd")))
    assert known == stats.ISSUE_TEXTS["repeated_id"] and unknown == "Something is wrong: odd"
    assert targets.is_strict("TEMPORAL") and not targets.is_strict("EVENT")
    assert [targets.needs_confirmation(s) for s in (*targets.SCOPES, "else")] == [False, False, True, True, False]


def test_repair_drift(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("xmin", "ymin", "xmax", "ymax"), v)])
    drift = lambda *c: geometry.repair_drift(box(0, 0, 1, 1), box(0, 0, 1, 1.5), *[F.lit(float(x)) for x in c])
    assert values(spark, drift(0, 0, 4), drift(-3, 0, 4), drift(0, 8, 4), drift(0, 9, 0)) == [0.5, 3.0, 2.0, 3.0]


def test_the_whole_purge(spark):
    assert retention.retention_cutoff(datetime(2024, 3, 1, tzinfo=UTC), 30) == "2024-01-31T00:00:00+00:00"
    rows = [event(n, n % 3, "UPDATE", {}, created=stamp(n)) for n in range(10)]
    rows += [event(20, 9, "INSERT", {}, created=stamp(20)), event(21, 9, "DELETE", {}, created=stamp(21)), event(22, 5, "UPDATE", {}, ref=3, created=stamp(22))]
    gone = list(event(23, 5, "UPDATE", {}, ref=8, created=stamp(23)))
    gone[-1] = stamp(24)
    j = journal(spark, [*rows, tuple(gone)])
    assert sorted(r[0] for r in retention.purge_invalidated(j).select("event_id").collect()) == [*range(10), 20, 21, 22]
    ids = lambda **k: sorted(r[0] for r in retention.purged(j, stamp(4), **k).select("event_id").collect())
    assert ids() == [*range(4, 10), 20, 21, 22, 23] and ids(garbage=True) == [*range(4, 10)]
    assert ids(most=4) == [20, 21, 22, 23]


def test_live_counts(spark, tmp_path):
    rows = [event(n, n, "INSERT" if n % 2 else "UPDATE", {}, created=stamp(1800 * n)) for n in range(6)]
    journal(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(journal(spark, []).schema).parquet(str(tmp_path / "in"))
    query = capture.live_counts(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["operation_type"], r["n_events"]) for r in spark.table("live").collect()) == [("INSERT", 1)] * 3 + [("UPDATE", 1)] * 3


def test_canonical_texts_are_equal_where_values_are(spark):
    texts = ["1", "1.0", '"1"', "true", '"true"', "null", "-0.0", "0", '"2024-01-01T00:00:00"', '"2024-01-01 00:00:00+00:00"', '"2024-01-01T01:00:00+01:00"', '"b64:AAE="', '"b64:AAE"', '"x"', '"X"', "1e0", "[1]", "[1.0]"]
    both = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    apart = both.where(payload.same_value(F.col("a"), F.col("b")) != payload.canonical(F.col("a")).eqNullSafe(payload.canonical(F.col("b"))))
    assert apart.collect() == []


def test_statistics_of_batches_with_a_replay(spark, tmp_path):
    path, log, bad = (str(tmp_path / x) for x in ("s", "j", "p"))
    rows = [event(n, n % 7, ["INSERT", "UPDATE", "DELETE"][n % 3], {}, created=stamp(n), ds=f"ogr::/{n % 2}.gpkg", ref=3 if n == 30 else None) for n in range(40)]
    part = lambda a, b: journal(spark, rows[a:b])
    for batch, (a, b) in enumerate([(0, 10), (10, 25), (25, 40)]):
        capture.append_batch(part(a, b), batch, log, bad, path)
    capture.append_batch(part(10, 25), 1, log, bad, path)
    read = lambda: {r[statistics.SOURCE]: r.asDict() for r in statistics.merged(statistics.partials(spark, path)).collect()}
    whole = {r[statistics.SOURCE]: r.asDict() for r in statistics.merged(statistics.partial(journal(spark, rows))).collect()}
    assert read() == whole and sum(r["n_events"] for r in whole.values()) == 40 and {r["n_entities_about"] for r in whole.values()} == {7}
    kept = statistics.partial(part(0, 10)).withColumn("batch", F.lit(0))
    statistics.fold(spark, path, 1)
    assert read() == whole
    kept.drop("batch").write.parquet(f"{path}/batch=0")  # as if the fold had stopped before it deleted this one
    assert read() == whole
    statistics.fold(spark, path, 2)
    assert read() == whole and {r[0] for r in statistics.partials(spark, path).select("batch").collect()} == {-3}


def test_a_grid_finds_its_columns_and_tells_what_it_leaves_out(spark):
    rows = [
        event(1, 1, "INSERT", {"all_attributes": {"b": 1, "created_at": "x"}}),
        event(2, 1, "UPDATE", {"changed_only": {"a": {"old": 5, "new": 6}, "updated_at": {"old": 1, "new": 2}}}, point(1), point(2)),
        event(3, 1, "UPDATE", {"changed_only": {}}),
    ]
    grid, told = search.discovered_grid(journal(spark, rows))
    assert grid.columns == ["event_id", "operation_type", "created_at", "b", "created_at_", "a", "changed", "geometry_changed"]
    assert [tuple(r)[3:] for r in grid.orderBy("event_id").collect()] == [("1", '"x"', None, None, False), (None, None, "5", ["a"], True), (None, None, None, [], True)]
    assert told.first().asDict() == {"n_rows": 3, "limit": 200, "truncated": False}
    grid, told = search.discovered_grid(journal(spark, rows), most=1)
    assert "a" not in grid.columns and told.first()["truncated"]
