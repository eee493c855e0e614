"""Registered queries on the smaller operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import geometry, identity, moments, payload
from stratalog.operators import drift, integrity, planning, retention, rewind, scope, search, snapshot, stats
from stratalog.plans.catalog import _COLLAPSE, _PAIRS, _WINDOW, AT, CUTOFF, LATER, LAYER, NOW, aliases, query
from stratalog.sources import journal as jr
from stratalog.streaming import capture

# --- lookups and lists -------------------------------------------------------------------------------------------------


@query("event_by_id", "SELECT event_id, operation_type, attributes_json FROM journal WHERE event_id = 41")
def event_by_id(j: DataFrame) -> DataFrame:
    return jr.event_by_id(j, 41).select("event_id", "operation_type", "attributes_json")


@query("session_events", f"SELECT event_id FROM journal WHERE session_id = 's7-{AT[:10]}' AND restored_from_event_id IS NULL ORDER BY event_id DESC LIMIT 10000")
def session_events(j: DataFrame) -> DataFrame:
    return search.session_events(j, f"s7-{AT[:10]}").select("event_id")


@query(
    "newest_of_each_source",
    _WINDOW + " SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY datasource_fingerprint ORDER BY created_at DESC, event_id DESC) AS n FROM win) WHERE n <= 100",
)
def newest_of_each_source(j: DataFrame) -> DataFrame:
    return rewind.newest_of_each(rewind.window_events(j, CUTOFF), 100).select("event_id")


@query("truncated_sources", _WINDOW + " SELECT datasource_fingerprint, count(*) AS n_events, count(*) - 100 AS n_dropped FROM win GROUP BY 1 HAVING count(*) > 100")
def truncated_sources(j: DataFrame) -> DataFrame:
    return rewind.truncated_sources(rewind.window_events(j, CUTOFF), 100)


@query("review_budget", f"SELECT count(*) AS n_events, least(count(*), 100) AS n_read, count(*) > 100 AS partial FROM journal WHERE invalidated_at IS NULL AND created_at <= '{AT}'")
def review_budget(j: DataFrame) -> DataFrame:
    return snapshot.review(j, AT, 100)[1].drop("reason")


@query("used_fingerprints", "SELECT DISTINCT datasource_fingerprint FROM journal ORDER BY 1 LIMIT 3")
def used_fingerprints(j: DataFrame) -> DataFrame:
    return search.used_fingerprints(j, 3)[0]


@query("used_fingerprints_told", "SELECT count(DISTINCT datasource_fingerprint) AS n_rows, 3 AS \"limit\", count(DISTINCT datasource_fingerprint) > 3 AS truncated FROM journal")
def used_fingerprints_told(j: DataFrame) -> DataFrame:
    return search.used_fingerprints(j, 3)[1]


@query("layer_names", f"SELECT DISTINCT layer_name_snapshot FROM journal WHERE datasource_fingerprint = '{LAYER}'")
def layer_names(j: DataFrame) -> DataFrame:
    return search.distinct_of(j, "layer_name_snapshot", LAYER)


@query("clipboard_lines", "SELECT event_id || chr(9) || coalesce(user_name, '') || chr(9) || coalesce(session_id, '') AS line FROM journal")
def clipboard_lines(j: DataFrame) -> DataFrame:
    return jr.as_tsv(j.select("event_id", "user_name", "session_id"))


@query(
    "settings_now",
    """, stored AS (SELECT 'last_' || operation_type AS k, CAST(max(event_id) AS VARCHAR) AS v FROM journal GROUP BY 1 UNION ALL SELECT 'retention_days', CAST(count(DISTINCT substr(created_at, 1, 10)) AS VARCHAR) FROM journal),
    kept AS (SELECT * FROM stored WHERE k NOT IN ('last_DELETE', 'last_UPDATE') UNION ALL SELECT 'last_UPDATE', CAST(count(*) AS VARCHAR) FROM journal WHERE operation_type = 'UPDATE' UNION ALL SELECT 'capture_enabled', 'false')
    SELECT coalesce(kept.k, d.k) AS setting_key, coalesce(kept.v, d.v) AS setting_value FROM kept FULL JOIN (VALUES ('capture_enabled', 'true'), ('retention_days', '365'), ('max_events', '1000000'), ('capture_inserts', 'true')) d(k, v) ON d.k = kept.k""",
)
def settings_now(j: DataFrame) -> DataFrame:
    """Settings that a journal's own counts set, of which one is taken away and two are changed."""
    pair = lambda k, v: [k.cast("string").alias("setting_key"), v.cast("string").alias("setting_value")]
    last = j.groupBy("operation_type").agg(F.max("event_id").alias("v")).select(*pair(F.concat(F.lit("last_"), "operation_type"), F.col("v")))
    days = j.agg(F.countDistinct(F.substring("created_at", 1, 10)).alias("v")).select(*pair(F.lit("retention_days"), F.col("v")))
    updates = j.agg(F.count_if(F.col("operation_type") == "UPDATE").alias("v")).select(*pair(F.lit("last_UPDATE"), F.col("v")))
    off = j.agg(F.lit("false").alias("v")).select(*pair(F.lit("capture_enabled"), F.col("v")))
    gone = j.agg(F.lit(None).alias("v")).select(*pair(F.lit("last_DELETE"), F.col("v")))
    return jr.settings(jr.changed_settings(last.union(days), updates.union(off).union(gone)))


_REGISTRY = "r AS (SELECT DISTINCT datasource_fingerprint, '/d/layer' || substr(layer_id_snapshot, 7) || '.gpkg|layername=l' AS source_uri FROM journal)"


@query(
    "registry_lookup",
    f""", {_REGISTRY}, w(f, known) AS (VALUES ('ogr::/f/layer0.gpkg|layername=l', 'ogr::/d/layer0.gpkg|layername=l'), ('ogr::/d/layer3.gpkg|layername=l', 'ogr::/d/layer3.gpkg|layername=l'), ('ogr::/x', 'none'))
    SELECT f AS fingerprint, datasource_fingerprint AS found_as, source_uri FROM w JOIN r ON known = datasource_fingerprint""",
)
def registry_lookup(j: DataFrame) -> DataFrame:
    wanted = j.sparkSession.createDataFrame([("ogr::/f/layer0.gpkg|layername=l",), ("ogr::/d/layer3.gpkg|layername=l",), ("ogr::/x",)], "fingerprint string")
    return jr.lookup_source(jr.journal_registry(j), aliases(j.sparkSession), wanted).select("fingerprint", "found_as", "source_uri")


@query(
    "target_layers",
    """ SELECT event_id, CASE WHEN layer_id_snapshot = 'layer_1' THEN 'layer_1' WHEN layer_id_snapshot = 'layer_0' THEN 'moved_0' WHEN layer_id_snapshot IN ('layer_2', 'layer_3') THEN 'other_2' END AS layer_id,
    CASE WHEN layer_id_snapshot = 'layer_1' THEN 'layer' ELSE 'source' END AS how FROM journal""",
)
def target_layers(j: DataFrame) -> DataFrame:
    there = [("layer_1", "ogr::/elsewhere", "/elsewhere"), ("moved_0", "ogr::/f/layer0.gpkg|layername=l|subset=y", "/f"), ("other_2", "ogr::/d/layer2.gpkg|layername=l", "/d")]
    layers = j.sparkSession.createDataFrame(there, "layer_id string, datasource_fingerprint string, source_uri string")
    return jr.target_layers(j, layers, jr.journal_registry(j), aliases(j.sparkSession)).select("event_id", "layer_id", "how")


# --- identity ------------------------------------------------------------------------------------------------------------



@query("fingerprint_splits", "SELECT DISTINCT datasource_fingerprint, 'ogr' AS provider, substr(datasource_fingerprint, 6) AS rest FROM journal")
def fingerprint_splits(j: DataFrame) -> DataFrame:
    return j.select("datasource_fingerprint", identity.provider_of("datasource_fingerprint").alias("provider"), identity.rest_of("datasource_fingerprint").alias("rest")).distinct()


@query("feature_identities", "SELECT event_id, '{\"fid\":' || event_id || CASE WHEN session_id IS NOT NULL THEN ',\"pk_field\":\"session\",\"pk_value\":\"' || session_id || '\"' WHEN user_name IS NOT NULL THEN ',\"pk_field\":\"user\",\"pk_value\":\"' || user_name || '\"' ELSE '' END || '}' AS id FROM journal")
def feature_identities(j: DataFrame) -> DataFrame:
    return j.select("event_id", identity.feature_identity(F.col("event_id"), [("session", F.col("session_id")), ("user", F.col("user_name"))]).alias("id"))


@query("same_sources", "SELECT event_id, event_id % 4 <> 3 AS same FROM journal")
def same_sources(j: DataFrame) -> DataFrame:
    """The source in another spelling: as it is, with a display token, relative to the project, or another one."""
    k, d = F.pmod("event_id", F.lit(4)), F.col("datasource_fingerprint")
    other = F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("|subset=a"))).when(k == 2, F.replace(d, F.lit("::/d/"), F.lit("::./"))).otherwise(F.concat(d, F.lit("x")))
    return j.select("event_id", identity.same_source(d, other, F.lit("/d/")).alias("same"))


@query("user_names", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 5 = 1 THEN 'own' WHEN user_name IS NULL THEN 'unknown' ELSE user_name END AS name FROM journal")
def user_names(j: DataFrame) -> DataFrame:
    k = F.pmod("event_id", F.lit(5))
    asked = F.when(k == 1, F.lit("  own\t")).when(k == 0, F.lit(" \x07 "))
    return j.select("event_id", identity.user_name(asked, F.when(k > 1, F.col("user_name"))).alias("name"))


@query("restore_modes", "SELECT DISTINCT provider_type, mode, true AS allowed FROM journal, (VALUES ('EVENT'), ('TEMPORAL')) m(mode)")
def restore_modes(j: DataFrame) -> DataFrame:
    modes = F.broadcast(identity.restore_modes(j.sparkSession))  # a few fixed rows
    return j.select("provider_type").distinct().join(modes, "provider_type").select("provider_type", "mode", "allowed")


# --- times and sizes -----------------------------------------------------------------------------------------------------


@query(
    "spans_of_all_lengths",
    """, s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1800 WHEN 1 THEN 7200 + event_id WHEN 2 THEN 86400 * (2 + event_id % 25) WHEN 3 THEN 86400 * (31 + event_id % 300) WHEN 4 THEN 86400 * 730 ELSE 86400 * (400 + event_id % 900) END AS s FROM journal),
    d AS (SELECT *, s // 86400 AS days FROM s)
    SELECT event_id, CASE WHEN days = 0 AND s < 3600 THEN '< 1 hour' WHEN days = 0 THEN s // 3600 || ' hours' WHEN days < 30 THEN days || ' days' WHEN days // 30 < 12 THEN days // 30 || ' months'
      WHEN (days % 365) // 30 > 0 THEN days // 365 || ' years ' || (days % 365) // 30 || ' months' ELSE days // 365 || ' years' END AS span,
      CASE WHEN s <= 86400 THEN 1 WHEN s <= 2592000 THEN 60 ELSE 3600 END AS step FROM d""",
)
def spans_of_all_lengths(j: DataFrame) -> DataFrame:
    e, day = F.col("event_id"), 86400
    k = F.pmod(e, F.lit(6))
    long = F.when(k == 2, day * (2 + e % 25)).when(k == 3, day * (31 + e % 300)).when(k == 4, F.lit(day * 730)).otherwise(day * (400 + e % 900))
    s = F.when(k == 0, F.lit(1800)).when(k == 1, 7200 + e).otherwise(long)
    start = F.lit("2020-01-01T00:00:00+00:00")
    end = F.date_format(F.timestamp_seconds(F.unix_seconds(start.cast("timestamp")) + s), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return j.select("event_id", moments.history_span(start, end).alias("span"), moments.granularity(s).alias("step"))


@query(
    "spellings",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN epoch(created_at::TIMESTAMPTZ)::BIGINT END AS s, substr(created_at, 1, 10) || ' ' || substr(created_at, 12, 8) || ' UTC' AS shown FROM journal""",
)
def spellings(j: DataFrame) -> DataFrame:
    c, k = F.col("created_at"), F.pmod("event_id", F.lit(4))
    text = F.when(k == 0, F.concat(F.substring(c, 1, 19), F.lit("+0000"))).when(k == 1, F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" "))).when(k == 2, F.substring(c, 1, 10)).otherwise(F.replace(c, F.lit("-"), F.lit("/")))
    return j.select("event_id", F.unix_seconds(moments.strict_instant(text)).alias("s"), moments.full_timestamp(c).alias("shown"))


@query("clamped_cutoffs", f"SELECT created_at, greatest(created_at, '{AT}') AS cutoff FROM (SELECT DISTINCT created_at FROM journal)")
def clamped_cutoffs(j: DataFrame) -> DataFrame:
    return j.select("created_at").distinct().select("created_at", moments.clamped_cutoff("created_at", F.lit(AT)).alias("cutoff"))


@query("marker_ticks", "SELECT min(epoch(created_at::TIMESTAMPTZ)::BIGINT) AS s FROM journal GROUP BY substr(created_at, 1, 10)")
def marker_ticks(j: DataFrame) -> DataFrame:
    ticks = j.select(moments.instant("created_at").alias("tick")).distinct()
    return moments.marker_ticks(ticks, 30 * 86400.0).select(F.unix_seconds("tick").alias("s"))


@query(
    "slider_places",
    f"SELECT event_id, (epoch(created_at::TIMESTAMPTZ)::BIGINT - epoch(TIMESTAMPTZ '2024-01-01T00:00:00+00:00')::BIGINT) // 60 AS place FROM journal WHERE created_at >= '{AT}'",
)
def slider_places(j: DataFrame) -> DataFrame:
    start = F.lit("2024-01-01T00:00:00+00:00").cast("timestamp")
    return j.where(F.col("created_at") >= AT).select("event_id", moments.slider_bucket(moments.instant("created_at"), start, F.lit(60)).alias("place"))


@query(
    "sizes",
    """, s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 1024 WHEN 1 THEN 1024 * (1 + event_id % 900) WHEN 2 THEN 1048576 * (1 + event_id % 900) ELSE 1073741824 * (1 + event_id % 9) END AS n FROM journal)
    SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS health,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS journal,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.2f MB', n / 1048576) END AS report,
      CASE WHEN n < 104857600 THEN 'critical' WHEN n < 524288000 THEN 'low' ELSE 'ok' END AS level FROM s""",
)
def sizes(j: DataFrame) -> DataFrame:
    e, k = F.col("event_id"), F.pmod("event_id", F.lit(4))
    n = F.when(k == 0, e % 1024).when(k == 1, 1024 * (1 + e % 900)).when(k == 2, (1 << 20) * (1 + e % 900)).otherwise(F.lit(1 << 30) * (1 + e % 9))
    return j.select("event_id", *[moments.size_text(n, s).alias(s) for s in ("health", "journal", "report")], stats.volume_level(n).alias("level"))


# --- values, shapes and schemas ------------------------------------------------------------------------------------------


@query("deltas", "SELECT event_id, string_agg(field || '=' || new || '>' || old, ';' ORDER BY field) AS delta FROM delta_cells GROUP BY 1")
def deltas(j: DataFrame) -> DataFrame:
    turned = F.transform_values(payload.inverted(payload.changes()), lambda _, v: F.concat(v["old"], F.lit(">"), v["new"]))
    return j.select("event_id", payload.as_text(turned).alias("delta")).where("delta <> ''")


@query("same_values", "SELECT event_id, event_id % 8 NOT IN (5, 6, 7) AS same FROM journal")
def same_values(j: DataFrame) -> DataFrame:
    pairs = [("1", "1.0"), ('"a"', '"a"'), ("null", "null"), ('"2024-01-01T10:00:00+02:00"', '"2024-01-01 08:00:00"'), ('"b64:YWI="', '"b64:YWI="'), ("true", "1"), ('"1"', "1"), ("null", '""')]
    k, a, b = F.pmod("event_id", F.lit(8)), F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (x, y) in enumerate(pairs):
        a, b = F.when(k == n, F.lit(x)).otherwise(a), F.when(k == n, F.lit(y)).otherwise(b)
    return j.select("event_id", payload.same_value(a, b).alias("same"))


@query(
    "field_mappings",
    "SELECT DISTINCT datasource_fingerprint, 'amount>amount;id>id;kind>kind' AS mapping FROM journal",
)
def field_mappings(j: DataFrame) -> DataFrame:
    out = drift.field_mapping(drift.compare(drift.captured_fields(j), _present(j)))
    return out.select("datasource_fingerprint", F.array_join(F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(e["key"], F.lit(">"), e["value"])), ";").alias("mapping"))


def _present(j: DataFrame) -> DataFrame:
    now = j.sparkSession.createDataFrame([("id", "bigint"), ("amount", "DOUBLE"), ("note", "text"), ("extra", "text")], "name string, type string")
    return j.select("datasource_fingerprint").distinct().join(F.broadcast(now))  # four fixed rows


@query("lost_fields", "SELECT DISTINCT datasource_fingerprint, n.* FROM journal, (VALUES ('kind', 'no such field'), ('note', 'date -> text')) n(name, reason)")
def lost_fields(j: DataFrame) -> DataFrame:
    return drift.dropped_fields(drift.compare(drift.captured_fields(j), _present(j)))


@query("restorable_sources", "SELECT DISTINCT datasource_fingerprint, 2 AS n_matched, 2 AS n_lost, false AS compatible FROM journal")
def restorable_sources(j: DataFrame) -> DataFrame:
    return drift.is_compatible(drift.compare(drift.captured_fields(j), _present(j)))


@query(
    "mapped_values",
    "SELECT event_id, field, CASE field WHEN 'id' THEN 'int' ELSE 'real' END AS family, CAST(value AS DOUBLE) AS number FROM (SELECT event_id, field, value FROM full_cells UNION ALL SELECT event_id, field, old FROM delta_cells) WHERE field IN ('id', 'amount')",
)
def mapped_values(j: DataFrame) -> DataFrame:
    return drift.mapped_values(j, drift.compare(drift.captured_fields(j), _present(j))).select("event_id", "field", "family", "number")


@query("moved_geometries", "SELECT event_id, geometry_wkb IS NOT DISTINCT FROM new_geometry_wkb AS same_bytes, geometry_wkb IS NOT DISTINCT FROM new_geometry_wkb AS same_shape, md5(hex(geometry_wkb)) AS digest FROM journal")
def moved_geometries(j: DataFrame) -> DataFrame:
    a, b = F.col("geometry_wkb"), F.col("new_geometry_wkb")
    return j.select("event_id", geometry.same_bytes(a, b).alias("same_bytes"), geometry.same_shape(a, b).alias("same_shape"), F.md5(F.hex(a)).alias("digest"))


# --- reports ---------------------------------------------------------------------------------------------------------------


@query("oldest_of_family", "SELECT min(created_at) AS first_at FROM journal WHERE datasource_fingerprint IN ('ogr::/d/layer2.gpkg|layername=l', 'ogr::/d/layer3.gpkg|layername=l')")
def oldest_of_family(j: DataFrame) -> DataFrame:
    wanted = j.sparkSession.createDataFrame([("ogr::/d/layer2.gpkg|layername=l",)], "fingerprint string")
    return stats.oldest_event(j, wanted, aliases(j.sparkSession))


@query("has_traces", "SELECT count(*) > 0 AS has_traces FROM journal WHERE restored_from_event_id IS NOT NULL AND invalidated_at IS NULL AND datasource_fingerprint = 'ogr::/d/layer0.gpkg|layername=l'")
def has_traces(j: DataFrame) -> DataFrame:
    wanted = j.sparkSession.createDataFrame([("ogr::/f/layer0.gpkg|layername=l",)], "fingerprint string")
    return stats.has_active_traces(j, wanted, aliases(j.sparkSession))


_DIAGNOSED = (
    _PAIRS
    + """, u AS (SELECT * FROM journal WHERE restored_from_event_id IS NULL), e AS (SELECT count(*) AS n FROM u WHERE entity_fingerprint IS NOT NULL GROUP BY entity_fingerprint)
    , d AS (SELECT (SELECT count(*) FROM u) AS total_events, (SELECT count(*) FROM e) AS total_entities, (SELECT count(invalidated_at) FROM journal) AS n_invalidated, (SELECT count(*) FROM pairs) AS n_pairs,
        (SELECT count(geometry_wkb) FROM u) AS n_geometry, (SELECT count(DISTINCT field_schema_json) FROM u) AS n_schemas, (SELECT count(*) FROM e WHERE n BETWEEN 2 AND 5) AS few)"""
)


@query("diagnostics", _DIAGNOSED + " SELECT total_events, total_entities, n_invalidated, n_pairs, n_geometry, n_schemas, few FROM d")
def diagnostics(j: DataFrame) -> DataFrame:
    few = F.coalesce(F.element_at("bins", F.lit("2-5")), F.lit(0)).alias("few")
    return stats.diagnostics(j).select("total_events", "total_entities", "n_invalidated", "n_pairs", "n_geometry", "n_schemas", few)


@query("diagnostic_lines", _DIAGNOSED + " SELECT unnest(['events: ' || total_events, 'entities: ' || total_entities, 'invalidated traces: ' || n_invalidated, 'insert and delete pairs: ' || n_pairs]) AS line FROM d")
def diagnostic_lines(j: DataFrame) -> DataFrame:
    told = stats.diagnostic_text(stats.diagnostics(j)).select("line")
    return told.where(F.col("line").rlike("^(events|entities|invalidated traces|insert and delete pairs): "))


@query(
    "all_issues",
    """SELECT * FROM (VALUES ('session_without_events', 2), ('source_without_events', 1)) x(issue, n) UNION ALL SELECT 'newer_layout', count(*) FROM journal WHERE event_id % 10 = 1 UNION ALL SELECT 'invalid_event', count(*) FROM journal WHERE event_id % 10 = 2
    UNION ALL SELECT 'repeated_id', count(*) FROM journal WHERE event_id % 10 = 4
    UNION ALL SELECT 'orphan_trace', count(*) FROM (SELECT restored_from_event_id AS r FROM journal UNION ALL SELECT restored_from_event_id FROM journal WHERE event_id % 10 = 4) WHERE r IS NOT NULL AND r NOT IN (SELECT event_id FROM journal WHERE restored_from_event_id IS NULL)""",
)
def all_issues(j: DataFrame) -> DataFrame:
    k, spark = F.pmod("event_id", F.lit(10)), j.sparkSession
    broken = j.unionByName(j.where(k == 4)).withColumns(
        {"event_schema_version": F.when(k == 1, 99).otherwise(F.col("event_schema_version")), "operation_type": F.when(k == 2, "MOVE").otherwise(F.col("operation_type"))}
    )
    more = jr.journal_registry(j).unionByName(spark.createDataFrame([("ogr::/none", "ogr", "/none", "none", NOW)], jr.journal_registry(j).schema))
    sessions = j.select("session_id").where("session_id IS NOT NULL").distinct().union(spark.createDataFrame([("empty1",), ("empty2",)], "session_id string"))
    return integrity.issues(broken, more, sessions)


#: Cycles of each source and day, eight kinds of them, that break each rule somewhere; the same for Spark and DuckDB.
_COUNTS = {
    "n_user": "count(CASE WHEN restored_from_event_id IS NULL THEN 1 END)", "traces": "count(restored_from_event_id) * max(CASE WHEN event_id % 8 = 3 THEN 6 ELSE 1 END)",
    "traces_invalidated": "count(invalidated_at)", "n_update": "count(CASE WHEN operation_type = 'UPDATE' THEN 1 END)", "n_delete": "count(CASE WHEN operation_type = 'DELETE' THEN 1 END)",
}
_CYCLE = {
    "cycle": "CASE WHEN g = 6 THEN 'undo' ELSE 'rewind' END", "plan_actions": "n_user", "apply_ok": "CASE WHEN g < 3 THEN 0 ELSE n_update END", "apply_skipped": "CASE WHEN g = 0 THEN n_user ELSE 0 END",
    "apply_fail": "CASE WHEN g IN (5, 6) THEN n_delete ELSE 0 END", "user": "n_user", "traces": "traces", "traces_invalidated": "traces_invalidated", "dedup_active": "CASE WHEN g IN (1, 2) THEN 0 ELSE n_user END",
    "dedup_dropped": "n_delete", "traces_written": "CASE WHEN g = 4 THEN 0 ELSE n_update END",
}
_BY_DAY = "datasource_fingerprint, substr(created_at, 1, 10) AS day, event_id % 8 AS g"


@query(
    "all_anomalies",
    f""", counted AS (SELECT {_BY_DAY}, {", ".join(f"{e} AS {n}" for n, e in _COUNTS.items())} FROM journal GROUP BY 1, 2, 3),
    cycles AS (SELECT datasource_fingerprint, day, g, {", ".join(f'{e} AS "{n}"' for n, e in _CYCLE.items())} FROM counted), c AS (SELECT *, greatest(traces - traces_invalidated, 0) AS active FROM cycles)
    SELECT datasource_fingerprint, day, g, concat_ws(',', CASE WHEN cycle = 'rewind' AND plan_actions > 0 AND apply_ok = 0 AND apply_skipped = plan_actions THEN 'all_skipped' END,
      CASE WHEN cycle = 'rewind' AND "user" > 0 AND dedup_active = 0 AND active > 0 THEN 'already_at_target' END, CASE WHEN cycle = 'rewind' AND "user" > 0 AND dedup_active = 0 AND active = 0 THEN 'all_collapsed_no_traces' END,
      CASE WHEN cycle = 'rewind' AND active >= 5 AND dedup_dropped < active // 2 THEN 'low_neutralization' END, CASE WHEN cycle = 'rewind' AND apply_ok > 0 AND traces_written = 0 THEN 'missing_traces' END,
      CASE WHEN apply_fail > 0 THEN 'apply_failures' END, CASE WHEN cycle = 'undo' AND apply_ok > 0 AND apply_fail > 0 THEN 'undo_partial' END) AS anomalies FROM c""",
)
def all_anomalies(j: DataFrame) -> DataFrame:
    base = j.selectExpr("*", "substr(created_at, 1, 10) AS day", "event_id % 8 AS g")
    counted = base.groupBy("datasource_fingerprint", "day", "g").agg(*[F.expr(e).alias(n) for n, e in _COUNTS.items()])
    cycles = counted.selectExpr("datasource_fingerprint", "day", "g", *[f"{e} AS `{n}`" for n, e in _CYCLE.items()])
    return stats.anomalies(cycles).select("datasource_fingerprint", "day", "g", "anomalies")


@query("all_reasons", "SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'bad operation_type' WHEN 4 THEN 'bad operation_type' WHEN 5 THEN 'empty attributes_json' ELSE 'empty created_at' END AS reason FROM journal WHERE event_id % 10 BETWEEN 3 AND 6")
def all_reasons(j: DataFrame) -> DataFrame:
    k = F.pmod("event_id", F.lit(10))
    bad = {"operation_type": F.when(k == 3, F.lit(None)).when(k == 4, "MOVE").otherwise(F.col("operation_type")), "attributes_json": F.when(k != 5, F.col("attributes_json")), "created_at": F.when(k == 6, "").otherwise(F.col("created_at"))}
    return jr.split_valid(j.withColumns(bad))[1].select("event_id", "reason")


_PG = "postgres::host=h port=5432 dbname=d schema=s table="
#: Names that a source of the journal is given, its registered place, and the verdict, by kind; ``u`` is the layer's number.
_NAMED = [
    ("'ogr::/a' || u || '.gpkg'", "'/a' || u || '.gpkg'", "'ogr::/a' || u || '.gpkg'", "canonical"),
    ("'ogr::/b' || u || '.gpkg|subset=x'", "'/b' || u || '.gpkg|subset=x'", "'ogr::/b' || u || '.gpkg'", "alias"),
    ("'ogr::/c' || u || '.gpkg|subset=x'", "'/c' || u || '.gpkg|subset=x'", "'ogr::/c' || u || '.gpkg'", "aliased"),
    ("'ogr::/d' || u || '.gpkg'", "''", "CAST(NULL AS STRING)", "without_uri"),
    ("'ogr::/e' || u || '.gpkg|subset=x'", "'/e' || u || '.gpkg|subset=x'", "'ogr::/e' || u || '.gpkg'", "ambiguous"),
    (f"'{_PG}s'", "'host=h dbname=d schema=s table=t'", f"'{_PG}t'", "ambiguous"),
    (f"'{_PG}u' || u", "'host=h dbname=d schema=s table=v' || u", f"'{_PG}v' || u", "alias"),
]


def _of_kind(place: int) -> str:
    return f"CASE event_id % {len(_NAMED)} {' '.join(f'WHEN {k} THEN {row[place]}' for k, row in enumerate(_NAMED))} END"


@query(
    "all_verdicts",
    f""", v AS (SELECT *, substr(layer_id_snapshot, 7) AS u FROM journal)
    SELECT DISTINCT {_of_kind(0)} AS datasource_fingerprint, {_of_kind(2)} AS target, CASE event_id % {len(_NAMED)} {" ".join(f"WHEN {k} THEN '{row[3]}'" for k, row in enumerate(_NAMED))} END AS verdict FROM v""",
)
def all_verdicts(j: DataFrame) -> DataFrame:
    told = j.selectExpr("event_id", "layer_id_snapshot", "layer_name_snapshot", "substr(layer_id_snapshot, 7) AS u")
    told = told.selectExpr("*", f"{_of_kind(0)} AS datasource_fingerprint", f"{_of_kind(1)} AS source_uri", f"{_of_kind(2)} AS target", f"event_id % {len(_NAMED)} AS kind")
    registry = told.select("datasource_fingerprint", F.split("datasource_fingerprint", "::")[0].alias("provider_type"), "source_uri").distinct()
    aliased = told.where("kind = 2").select(F.col("datasource_fingerprint").alias("alias_fingerprint"), F.col("target").alias("target_fingerprint"))
    turned = told.where("kind = 4").select(F.col("target").alias("alias_fingerprint"), F.col("datasource_fingerprint").alias("target_fingerprint"))
    return scope.reconcile(told, registry, aliased.union(turned).distinct())


@query(
    "blocked_plans",
    _COLLAPSE
    + f""", a AS (SELECT l.datasource_fingerprint, l.entity FROM least_events l), n AS (SELECT DISTINCT datasource_fingerprint FROM a)
    SELECT datasource_fingerprint, 'BLOCKED' AS verdict, CASE WHEN datasource_fingerprint = '{LAYER}' THEN 'history_purged,behind_purge_horizon' ELSE 'history_purged' END AS blocking FROM n""",
)
def blocked_plans(j: DataFrame) -> DataFrame:
    oldest = j.select("datasource_fingerprint").distinct().withColumn("first_at", F.lit(LATER))
    horizons = j.sparkSession.createDataFrame([(LAYER, AT)], "datasource_fingerprint string, purged_until string")
    return planning.preflight(rewind.rewind_events(rewind.window_events(j, CUTOFF)), CUTOFF, oldest, horizons).select("datasource_fingerprint", "verdict", F.regexp_replace("blocking", "too_many_(events|entities),", "").alias("blocking"))


@query("event_plan", "SELECT event_id, CASE operation_type WHEN 'DELETE' THEN 'INSERT' WHEN 'INSERT' THEN 'DELETE' ELSE 'UPDATE' END AS compensation, coalesce(entity_fingerprint, 'eid_' || event_id) AS entity_fingerprint FROM journal WHERE restored_from_event_id IS NULL")
def event_plan(j: DataFrame) -> DataFrame:
    return planning.actions(j.where(~jr.is_trace()), "EVENT").select("event_id", "compensation", "entity_fingerprint")




@query("plan_counts", "SELECT datasource_fingerprint, CASE operation_type WHEN 'DELETE' THEN 'INSERT' WHEN 'INSERT' THEN 'DELETE' ELSE 'UPDATE' END AS compensation, count(*) AS n_actions FROM journal WHERE restored_from_event_id IS NULL AND entity_fingerprint IS NOT NULL GROUP BY 1, 2")
def plan_counts(j: DataFrame) -> DataFrame:
    return planning.operation_counts(planning.actions(j.where(~jr.is_trace())))


@query(
    "plan_lines",
    """SELECT datasource_fingerprint, count(*) FILTER (WHERE operation_type = 'DELETE') || ' inserts, ' || count(*) FILTER (WHERE operation_type = 'UPDATE') || ' updates, ' || count(*) FILTER (WHERE operation_type = 'INSERT') || ' deletes on '
    || count(DISTINCT entity_fingerprint) || ' entities' AS line FROM journal WHERE restored_from_event_id IS NULL AND entity_fingerprint IS NOT NULL GROUP BY 1""",
)
def plan_lines(j: DataFrame) -> DataFrame:
    return planning.report(planning.actions(j.where(~jr.is_trace())))


@query("capability_gaps", "SELECT DISTINCT datasource_fingerprint, 'weak_identity' AS remark FROM journal")
def capability_gaps(j: DataFrame) -> DataFrame:
    sources = jr.journal_registry(j).withColumn("provider_type", F.lit("delimitedtext"))
    return planning.capability_gaps(planning.actions(j.where(~jr.is_trace())), sources)


@query("purge_session", f"SELECT event_id FROM journal WHERE session_id IS DISTINCT FROM 's7-{AT[:10]}'")
def purge_session(j: DataFrame) -> DataFrame:
    return retention.purge_session(j, f"s7-{AT[:10]}").select("event_id")


@query("purge_orphans", _PAIRS + " SELECT event_id FROM journal WHERE event_id NOT IN (SELECT event_id FROM orphans)")
def purge_orphans(j: DataFrame) -> DataFrame:
    return retention.purge_orphan_traces(j).select("event_id")


@query("shared_fingerprints", "SELECT 'ogr::/all' AS datasource_fingerprint, count(DISTINCT layer_id_snapshot) AS n_layers FROM journal")
def shared_fingerprints(j: DataFrame) -> DataFrame:
    return scope.shared_fingerprints(j.withColumn("datasource_fingerprint", F.lit("ogr::/all")))


@query("write_pressure", "SELECT event_id, CASE WHEN event_id * 7 >= 50000 THEN 'refuse' WHEN event_id * 7 >= 40000 THEN 'flush' WHEN event_id * 7 >= 10000 THEN 'warn' ELSE 'go' END AS advice FROM journal")
def write_pressure(j: DataFrame) -> DataFrame:
    return j.select("event_id", capture.pressure(F.col("event_id") * 7).alias("advice"))


@query(
    "captured_events",
    """, img AS (SELECT event_id, entity, operation_type AS op, event_id % 5 AS k FROM keyed WHERE ref IS NULL)
    SELECT event_id::VARCHAR AS session_id, CASE k WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
    CASE k WHEN 0 THEN '{"all_attributes":{"a":1}}' WHEN 1 THEN '{"all_attributes":{"a":2}}' ELSE '{"changed_only":{"a":{"new":2,"old":1}}}' END AS attributes_json FROM img WHERE k < 3""",
)
def captured_events(j: DataFrame) -> DataFrame:
    """Images of edits: inserts, deletes, changes, changes of an audit field only, and the engine's own writes."""
    k = F.pmod("event_id", F.lit(5))
    m = lambda **v: F.create_map(*[F.lit(x) for pair in v.items() for x in pair])
    none = F.lit(None).cast("map<string,string>")
    changes = j.where(~jr.is_trace()).select(
        "datasource_fingerprint", "provider_type", F.lit("l").alias("layer_name"), F.lit("1").alias("fid"), "user_name", F.col("event_id").cast("string").alias("session_id"), F.col("created_at").alias("committed_at"),
        F.when(k == 4, "restore").otherwise("user").alias("writer"),
        F.when(k == 0, none).when(k == 1, m(a="2")).otherwise(m(a="1", updated_at="1")).alias("old_attributes"),
        F.when(k == 0, m(a="1")).when(k == 1, none).when(k == 3, m(a="1", updated_at="2")).otherwise(m(a="2", updated_at="1")).alias("new_attributes"),
        F.lit(None).cast("binary").alias("old_geometry"), F.lit(None).cast("binary").alias("new_geometry"),
    )
    return capture.events_of(changes).select("session_id", "operation_type", "attributes_json")
