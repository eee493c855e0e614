"""A journal made of the ``events`` test table, by expressions that Spark and DuckDB both run.

Entities live in four sources; signups insert, errors delete, other events update; some purchases are traces of the event
before them, half of these invalidated; a few events are missing, so some traces have lost their source. Payloads come in
all shapes, amounts are whole cents, geometries are points on a small grid.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.session import shared_folder
from stratalog.sources.journal import JOURNAL as JOURNAL_SCHEMA

STAMP = {"spark": "date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss')", "duckdb": "strftime(ts, '%Y-%m-%dT%H:%M:%S')"}


def _number(expression: str, count: int) -> str:
    """Little-endian hexadecimal of a small whole number as a double."""
    whens = " ".join(f"WHEN {k} THEN '{struct.pack('<d', k).hex().upper()}'" for k in range(count))
    return f"CASE ({expression}) % {count} {whens} END"


def _point(n: str) -> str:
    return f"unhex('0101000000' || {_number(n, 7)} || {_number(n, 5)})"


BASE = {
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "event_type",
    "stamp": "{stamp} || '+00:00'",
    "cents": "CAST(round(value * 100) AS BIGINT)",
    "ds": "'ogr::/d/layer' || CAST(user_id % 4 AS STRING) || '.gpkg|layername=l'",
    "no": "CASE WHEN event_id % 5 = 0 THEN user_id ELSE 1000 + user_id * 20 + event_id % 20 END",
    "op": "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END",
    "marked": "event_type = 'purchase' AND event_id % 3 = 0",
}
W = "OVER (PARTITION BY ds, no ORDER BY event_id)"
LAGGED = {
    "prev_id": f"lag(event_id) {W}",
    "prev_op": f"lag(op) {W}",
    "prev_marked": f"lag(marked) {W}",
    "prev_cents": f"coalesce(lag(cents) {W}, 0)",
}
TYPED = {"trace": "marked AND prev_id IS NOT NULL AND NOT prev_marked"}
_C, _P, _N = "CAST(cents AS STRING)", "CAST(prev_cents AS STRING)", "CAST(no AS STRING)"
PAYLOAD = f"""CASE
    WHEN trace THEN '{{"_restore_ref": ' || CAST(prev_id AS STRING) || '}}'
    WHEN op <> 'UPDATE' THEN '{{"all_attributes": {{"id": ' || {_N} || ', "amount": ' || {_C} || ', "kind": "' || event_type || '"}}}}'
    WHEN event_type = 'view' AND event_id % 4 = 0 THEN '{{"changed_only": {{}}}}'
    WHEN event_id % 13 = 0 THEN '{{"changed_only": {{"updated_at": {{"old": "a", "new": "b"}}}}}}'
    WHEN event_id % 17 = 0 THEN '{{"changed_only": {{"amount": [' || {_P} || ', ' || {_C} || ']}}}}'
    WHEN event_id % 11 = 0 THEN '{{"changed_only": {{"amount": {{"old": ' || {_P} || ', "new": ' || {_C} || '}}, "note": {{"old": null, "new": "' || event_type || '"}}}}}}'
    ELSE '{{"changed_only": {{"amount": {{"old": ' || {_P} || ', "new": ' || {_C} || '}}}}}}' END"""
JOURNAL = {
    "event_id": "event_id",
    "project_fingerprint": "'project::/d/p'",
    "datasource_fingerprint": "ds",
    "layer_id_snapshot": "'layer_' || CAST(user_id % 4 AS STRING)",
    "layer_name_snapshot": "'Layer ' || CAST(user_id % 4 AS STRING)",
    "provider_type": "'ogr'",
    "feature_identity_json": f"'{{\"fid\": ' || {_N} || ', \"pk_field\": \"id\", \"pk_value\": ' || {_N} || '}}'",
    "operation_type": "CASE WHEN NOT trace THEN op WHEN prev_op = 'INSERT' THEN 'DELETE' WHEN prev_op = 'DELETE' THEN 'INSERT' ELSE 'UPDATE' END",
    "attributes_json": PAYLOAD,
    "geometry_wkb": f"CASE WHEN trace OR (op = 'UPDATE' AND event_id % 2 = 1) THEN NULL WHEN op = 'INSERT' THEN {_point('event_id')} ELSE {_point('prev_cents')} END",
    "geometry_type": "'Point'",
    "crs_authid": "'EPSG:4326'",
    "field_schema_json": "CASE WHEN event_id % 3 = 0 THEN '[{\"name\": \"id\", \"type\": \"int8\"}, {\"name\": \"amount\", \"type\": \"numeric\"}]'"
    " ELSE '[{\"name\": \"id\", \"type\": \"int8\"}, {\"name\": \"kind\", \"type\": \"text\"}, {\"name\": \"note\", \"type\": \"date\"}]' END",
    "user_name": "'user' || CAST(user_id AS STRING)",
    "session_id": "CASE WHEN NOT trace THEN 's' || CAST(user_id AS STRING) || '-' || substr(stamp, 1, 10) END",
    "created_at": "stamp",
    "restored_from_event_id": "CASE WHEN trace THEN prev_id END",
    "entity_fingerprint": f"CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'pk:id=' || {_N} END",
    "event_schema_version": "CAST(6 AS INT)",
    "new_geometry_wkb": f"CASE WHEN trace OR op = 'DELETE' OR (op = 'UPDATE' AND event_id % 2 = 1) THEN NULL ELSE {_point('event_id')} END",
    "invalidated_at": "CASE WHEN trace AND event_id % 2 = 0 THEN stamp END",
}
KEPT = "trace OR event_id % 29 <> 0"


def derived_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda columns: [f"{e} AS {n}" for n, e in columns.items()]
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.replace("{stamp}", STAMP["spark"]) for x in named(BASE)])
    typed = base.selectExpr("*", *named(LAGGED)).selectExpr("*", *named(TYPED))
    return typed.where(KEPT).selectExpr(*named(JOURNAL))


_loaded: dict[tuple[str, str], str] = {}


def loaded_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``derived_journal`` as a table, as a journal is kept: written once for a session and folder, then read from files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        path = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
        derived_journal(spark, sf_dir).write.parquet(path)
        _loaded[key] = path
    return spark.read.schema(JOURNAL_SCHEMA).parquet(_loaded[key])


def derived_sql() -> str:
    """The same as the CTE ``journal`` for DuckDB."""
    named = lambda columns: ",\n  ".join(f"{e} AS {n}" for n, e in columns.items())
    base = named(BASE).replace("{stamp}", STAMP["duckdb"])
    return f"""j0 AS (SELECT {base} FROM events),
j1 AS (SELECT *, {named(LAGGED)} FROM j0),
j2 AS (SELECT *, {named(TYPED)} FROM j1),
journal AS (SELECT {named(JOURNAL)} FROM j2 WHERE {KEPT})"""
