"""Registered queries on applying plans and restoring events, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.operators import applying, claims, ladder, rewind, sequence, shapes, snapshot, targets
from stratalog.plans.catalog import _ACTIONS, _COLLAPSE, AT, CUTOFF, LATER, _state_sql, query
from stratalog.session import settled
from stratalog.sources import journal as jr

END = "2025-01-01T00:00:00+00:00"
#: Actions that the source turns down, and a field of one source that can't be written, in the registered queries.
REFUSED, LOST = "event_id % 1000 = 7", ("ogr::/d/layer1.gpkg|layername=l", "note")

#: Views of a plan judged against the state at ``END``: ``decided`` has an outcome for each action.
_DECIDED = (
    _COLLAPSE
    + _ACTIONS
    + _state_sql(END)
    + f"""
    , state_cells AS (SELECT datasource_fingerprint, entity, field, value FROM (
        SELECT *, row_number() OVER (PARTITION BY datasource_fingerprint, entity, field ORDER BY created_at DESC, event_id DESC) AS n FROM written WHERE created_at <= '{END}') WHERE n = 1
        AND (datasource_fingerprint, entity) IN (SELECT datasource_fingerprint, entity FROM state))
    , plan AS (SELECT a.*, j.created_at FROM acts a JOIN journal j USING (event_id) WHERE a.entity_fingerprint IS NOT NULL AND a.entity_fingerprint <> '')
    , plan_cells AS (
      SELECT p.datasource_fingerprint, p.entity, p.event_id, p.created_at, d.field, d.old FROM plan p JOIN delta_cells d USING (event_id) WHERE compensation = 'UPDATE' AND fused = 1
      UNION ALL SELECT p.datasource_fingerprint, p.entity, p.event_id, p.created_at, c.field, c.old FROM plan p JOIN cells c USING (datasource_fingerprint, entity) WHERE compensation = 'UPDATE' AND fused > 1)
    , full_plan_cells AS (
      SELECT p.event_id, f.field, f.value FROM plan p JOIN full_cells f USING (event_id) WHERE compensation = 'INSERT' AND fused = 1
      UNION ALL SELECT p.event_id, c.field, c.old FROM plan p JOIN cells c USING (datasource_fingerprint, entity) WHERE compensation = 'INSERT' AND fused > 1
      UNION ALL SELECT p.event_id, b.field, b.value FROM plan p JOIN base b USING (datasource_fingerprint, entity) WHERE compensation = 'INSERT' AND fused > 1
        AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.datasource_fingerprint = b.datasource_fingerprint AND c.entity = b.entity AND c.field = b.field))
    , olds AS (SELECT datasource_fingerprint, entity, field, arg_min(old, (created_at, event_id)) AS old FROM plan_cells GROUP BY 1, 2, 3)
    , moves AS (SELECT datasource_fingerprint, entity, arg_min(shape, (created_at, event_id)) AS g FROM plan WHERE compensation = 'UPDATE' AND shape IS NOT NULL GROUP BY 1, 2)
    , newer AS (SELECT event_id, lead(shape) OVER (PARTITION BY datasource_fingerprint, entity ORDER BY created_at, event_id) AS next_shape FROM plan WHERE compensation = 'UPDATE' AND shape IS NOT NULL)
    , apart AS (SELECT DISTINCT o.datasource_fingerprint, o.entity FROM olds o LEFT JOIN state_cells s USING (datasource_fingerprint, entity, field) WHERE s.value IS DISTINCT FROM o.old)
    , met AS (
      SELECT p.*, s.entity IS NOT NULL AS there, s.shape AS state_shape, EXISTS (SELECT 1 FROM plan q WHERE q.datasource_fingerprint = p.datasource_fingerprint AND q.entity = p.entity AND q.compensation = 'INSERT') AS coming,
        m.g IS NOT NULL AS has_move, m.g AS move_shape, coalesce(n.next_shape, s.shape) AS then_shape,
        NOT EXISTS (SELECT 1 FROM apart x WHERE x.datasource_fingerprint = p.datasource_fingerprint AND x.entity = p.entity) AS same
      FROM plan p LEFT JOIN state s USING (datasource_fingerprint, entity) LEFT JOIN moves m USING (datasource_fingerprint, entity) LEFT JOIN newer n USING (event_id))
    , decided AS (SELECT *, CASE
        WHEN compensation = 'INSERT' THEN CASE WHEN there THEN 'skipped_idempotent' ELSE 'applied' END
        WHEN compensation = 'DELETE' THEN CASE WHEN there OR coming THEN 'applied' ELSE 'skipped_idempotent' END
        WHEN coming AND NOT there THEN 'applied' WHEN NOT there THEN 'failed_target_absent'
        WHEN same AND (NOT has_move OR state_shape IS NOT DISTINCT FROM move_shape) THEN 'skipped_idempotent'
        WHEN shape IS NOT NULL AND then_shape IS DISTINCT FROM new_shape AND then_shape IS DISTINCT FROM shape THEN 'failed_geometry_drift'
        ELSE 'applied' END AS outcome FROM met)"""
)
_BUCKETS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in applying.OUTCOMES)
_SUMS = ", ".join(f"count(*) FILTER (WHERE outcome IN ({', '.join(repr(o) for o, v in applying.OUTCOMES.items() if v == k)})) AS apply_{k}" for k in ("ok", "skipped", "fail"))


def _counts(view: str) -> str:
    return f" SELECT datasource_fingerprint, {_BUCKETS}, {_SUMS}, count(*) AS plan_actions, 0 AS unknown, true AS holds FROM {view} GROUP BY 1"


#: The state after the actions of a view ``done``.
_APPLIED = """
    , done_olds AS (SELECT datasource_fingerprint, entity, field, arg_min(old, (created_at, event_id)) AS old FROM plan_cells WHERE event_id IN (SELECT event_id FROM done) GROUP BY 1, 2, 3)
    , done_moves AS (SELECT datasource_fingerprint, entity, arg_min(shape, (created_at, event_id)) AS g FROM done WHERE compensation = 'UPDATE' AND shape IS NOT NULL GROUP BY 1, 2)
    , inserts AS (SELECT datasource_fingerprint, entity, min((created_at, event_id)) AS k, arg_min(event_id, (created_at, event_id)) AS insert_id, arg_min(coalesce(shape, ''), (created_at, event_id)) AS insert_shape FROM done WHERE compensation = 'INSERT' GROUP BY 1, 2)
    , after_keys AS (SELECT datasource_fingerprint, entity FROM (SELECT datasource_fingerprint, entity FROM state UNION SELECT datasource_fingerprint, entity FROM inserts)
      WHERE (datasource_fingerprint, entity) NOT IN (SELECT datasource_fingerprint, entity FROM done WHERE compensation = 'DELETE'))
    , after_base AS (SELECT * FROM state_cells UNION ALL SELECT i.datasource_fingerprint, i.entity, f.field, f.value FROM inserts i JOIN full_plan_cells f ON f.event_id = i.insert_id
      WHERE (i.datasource_fingerprint, i.entity) NOT IN (SELECT datasource_fingerprint, entity FROM state))
    , after_cells AS (SELECT datasource_fingerprint, entity, field, old AS value FROM done_olds
      UNION ALL SELECT b.* FROM after_base b WHERE NOT EXISTS (SELECT 1 FROM done_olds o WHERE o.datasource_fingerprint = b.datasource_fingerprint AND o.entity = b.entity AND o.field = b.field))
    , after_text AS (SELECT datasource_fingerprint, entity, string_agg(field || '=' || value, ';' ORDER BY field) AS attributes FROM after_cells GROUP BY 1, 2)
    , after AS (SELECT k.datasource_fingerprint, k.entity, t.attributes, CASE WHEN m.g IS NOT NULL THEN m.g ELSE coalesce(s.shape, nullif(i.insert_shape, '')) END AS shape
      FROM after_keys k LEFT JOIN after_text t USING (datasource_fingerprint, entity) LEFT JOIN state s USING (datasource_fingerprint, entity)
      LEFT JOIN done_moves m USING (datasource_fingerprint, entity) LEFT JOIN inserts i USING (datasource_fingerprint, entity))"""
_DONE = ", done AS (SELECT * FROM decided WHERE outcome IN ('applied', 'applied_partial'))"


#: What deciding and applying a plan reads of an event; a plan is written and dealt anew several times.
_READ = ["event_id", "datasource_fingerprint", "feature_identity_json", "operation_type", "attributes_json", "geometry_wkb", "created_at", "restored_from_event_id", "entity_fingerprint", "new_geometry_wkb", "invalidated_at"]


def _decided(j: DataFrame, columns: list[str] = _READ, **more) -> tuple[DataFrame, DataFrame]:
    now = settled(snapshot.state_at(j, END))
    return now, settled(applying.outcomes(now, rewind.rewind_events(rewind.window_events(j.select(*columns), CUTOFF)), **more))


def _flat(state: DataFrame) -> DataFrame:
    return state.select("datasource_fingerprint", "entity", payload.as_text(F.col("attributes")).alias("attributes"), F.hex("geometry_wkb").alias("shape"))


@query("apply_outcomes", _DECIDED + _counts("decided"))
def apply_outcomes(j: DataFrame) -> DataFrame:
    return applying.conserved(applying.outcome_counts(_decided(j)[1]))


@query("applied_state", _DECIDED + _DONE + _APPLIED + " SELECT * FROM after")
def applied_state(j: DataFrame) -> DataFrame:
    now, decided = _decided(j)
    return _flat(applying.apply_plan(now, decided))


_ROWS = """
    , was AS (SELECT datasource_fingerprint, count(*) AS was FROM state GROUP BY 1), now AS (SELECT datasource_fingerprint, count(*) AS now FROM after GROUP BY 1)
    , due AS (SELECT datasource_fingerprint, count(*) FILTER (WHERE compensation = 'INSERT' AND outcome = 'applied') - count(*) FILTER (WHERE compensation = 'DELETE' AND outcome = 'applied') AS expected FROM decided GROUP BY 1)
    SELECT datasource_fingerprint, expected, coalesce(now, 0) - coalesce(was, 0) AS measured, expected = coalesce(now, 0) - coalesce(was, 0) AS holds
    FROM due LEFT JOIN was USING (datasource_fingerprint) LEFT JOIN now USING (datasource_fingerprint)"""


@query("apply_row_counts", _DECIDED + _DONE + _APPLIED + _ROWS)
def apply_row_counts(j: DataFrame) -> DataFrame:
    now, decided = _decided(j)
    return applying.row_count_check(now, applying.apply_plan(now, decided), decided)


#: ``decided`` where the source turns some actions down and can't take one field.
_HINDERED = (
    _DECIDED
    + f""", partly AS (SELECT * REPLACE (CASE WHEN outcome = 'applied' AND datasource_fingerprint = '{LOST[0]}' AND (
        (compensation = 'UPDATE' AND EXISTS (SELECT 1 FROM olds o WHERE o.datasource_fingerprint = d.datasource_fingerprint AND o.entity = d.entity AND o.field = '{LOST[1]}'))
        OR (compensation = 'INSERT' AND EXISTS (SELECT 1 FROM full_plan_cells f WHERE f.event_id = d.event_id AND f.field = '{LOST[1]}'))) THEN 'applied_partial' ELSE outcome END AS outcome) FROM decided d)
    , hindered AS (SELECT * REPLACE (CASE WHEN {REFUSED} AND outcome <> 'skipped_idempotent' THEN 'failed' ELSE outcome END AS outcome) FROM partly)
    , strict AS (SELECT * REPLACE (CASE WHEN outcome IN ('applied', 'applied_partial') AND datasource_fingerprint IN (SELECT datasource_fingerprint FROM hindered WHERE outcome = 'failed') THEN 'rolled_back' ELSE outcome END AS outcome) FROM hindered)"""
)


def _hindered(j: DataFrame) -> tuple[DataFrame, DataFrame]:
    lost = j.sparkSession.createDataFrame([LOST], "datasource_fingerprint string, field string")
    return _decided(j, refused=j.where(REFUSED).select("event_id"), lost=lost)


@query("best_effort_outcomes", _HINDERED + _counts("hindered"))
def best_effort_outcomes(j: DataFrame) -> DataFrame:
    return applying.conserved(applying.outcome_counts(_hindered(j)[1]))


@query("strict_outcomes", _HINDERED + _counts("strict"))
def strict_outcomes(j: DataFrame) -> DataFrame:
    return applying.conserved(applying.outcome_counts(applying.rolled_back(_hindered(j)[1])))


@query("strict_state", _HINDERED + ", done AS (SELECT * FROM strict WHERE outcome IN ('applied', 'applied_partial'))" + _APPLIED + " SELECT * FROM after")
def strict_state(j: DataFrame) -> DataFrame:
    now, decided = _hindered(j)
    return _flat(applying.apply_plan(now, decided))


@query(
    "restore_traces",
    _DECIDED
    + """ SELECT event_id AS source_id, compensation AS operation_type, '{"_restore_ref": ' || event_id || '}' AS attributes_json, event_id AS restored_from_event_id FROM decided WHERE outcome = 'applied'""",
)
def restore_traces(j: DataFrame) -> DataFrame:
    out = applying.traces_of(_decided(j, j.columns)[1], LATER, "restorer", 10_000_000)
    return out.select(F.col("restored_from_event_id").alias("source_id"), "operation_type", "attributes_json", "restored_from_event_id")


# --- single events against the rows of a layer -------------------------------------------------------------------------

#: Some events have no key but a row number only, and some rows have another number than their entity had.
_NUMBERED = "event_id % 3 = 0"


def _layer(j: DataFrame) -> DataFrame:
    number = F.regexp_extract("entity", r"=(\d+)", 1).cast("long")
    fid = number + F.when(number % 7 == 0, 1_000_000).otherwise(0)
    return settled(snapshot.state_at(j, LATER).select("datasource_fingerprint", fid.alias("fid"), "attributes", "geometry_wkb"))


def _users(j: DataFrame) -> DataFrame:
    number = F.get_json_object("feature_identity_json", "$.fid")
    bare = F.concat(F.lit('{"fid": '), number, F.lit("}"))
    return j.where(~jr.is_trace()).withColumn("feature_identity_json", F.when(F.expr(_NUMBERED), bare).otherwise(F.col("feature_identity_json")))


_LAYER = (
    _state_sql(LATER)
    + f"""
    , row_cells AS (SELECT datasource_fingerprint, entity, field, value FROM (
        SELECT *, row_number() OVER (PARTITION BY datasource_fingerprint, entity, field ORDER BY created_at DESC, event_id DESC) AS n FROM written WHERE created_at <= '{LATER}') WHERE n = 1
        AND (datasource_fingerprint, entity) IN (SELECT datasource_fingerprint, entity FROM state))
    , layer_rows AS (SELECT *, no + CASE WHEN no % 7 = 0 THEN 1000000 ELSE 0 END AS row_fid FROM (SELECT *, CAST(regexp_extract(entity, '=(\\d+)', 1) AS BIGINT) AS no FROM state))
    , users AS (SELECT *, CAST(feature_identity_json->>'fid' AS BIGINT) AS no, event_id % 3 = 0 AS bare FROM keyed WHERE ref IS NULL)
    , by_pk AS (SELECT r.datasource_fingerprint, c.value AS pk, min(row_fid) AS target_fid FROM layer_rows r JOIN row_cells c USING (datasource_fingerprint, entity) WHERE c.field = 'id' GROUP BY 1, 2)
    , found AS (SELECT u.*, CASE WHEN bare THEN f.row_fid ELSE p.target_fid END AS target_fid, CASE WHEN bare AND f.row_fid IS NOT NULL THEN 'fid' WHEN NOT bare AND p.target_fid IS NOT NULL THEN 'pk' END AS found_by
      FROM users u LEFT JOIN by_pk p ON p.datasource_fingerprint = u.datasource_fingerprint AND p.pk = CAST(u.no AS VARCHAR) LEFT JOIN layer_rows f ON f.datasource_fingerprint = u.datasource_fingerprint AND f.row_fid = u.no)
    , target AS (SELECT f.*, r.entity AS row_entity, r.shape AS row_shape FROM found f LEFT JOIN layer_rows r ON r.datasource_fingerprint = f.datasource_fingerprint AND r.row_fid = f.target_fid)
    , sides AS (SELECT event_id, field, value AS old, value AS new FROM full_cells UNION ALL SELECT event_id, field, old, new FROM delta_cells WHERE field <> 'updated_at')
    , compared AS (SELECT t.event_id, count(s.field) AS n, count(c.field) AS shared, count(*) FILTER (WHERE c.field IS NOT NULL AND c.value IS DISTINCT FROM s.new) AS new_apart,
        count(*) FILTER (WHERE c.field IS NOT NULL AND c.value IS DISTINCT FROM s.old) AS old_apart
      FROM target t LEFT JOIN sides s USING (event_id) LEFT JOIN row_cells c ON c.datasource_fingerprint = t.datasource_fingerprint AND c.entity = t.row_entity AND c.field = s.field GROUP BY 1)
    , proofs AS (SELECT t.*, n, shared, new_apart, old_apart, hex(new_geometry_wkb) AS new_shape, hex(geometry_wkb) AS old_shape, CASE WHEN target_fid IS NULL THEN 'target_absent' WHEN found_by = 'pk' THEN 'pk'
        WHEN new_geometry_wkb IS NOT NULL THEN CASE WHEN row_shape IS NOT DISTINCT FROM hex(new_geometry_wkb) THEN 'post_geometry' ELSE 'geometry_mismatch' END
        WHEN n = 0 THEN 'nothing_captured' WHEN shared = 0 THEN 'nothing_to_compare' WHEN new_apart = 0 THEN 'post_attributes' ELSE 'attribute_mismatch' END AS proof
      FROM target t JOIN compared USING (event_id))"""
)


@query("resolved_targets", _LAYER + " SELECT event_id, target_fid, found_by FROM target")
def resolved_targets(j: DataFrame) -> DataFrame:
    return targets.resolved(_users(j), _layer(j)).select("event_id", "target_fid", "found_by")


@query("update_proofs", _LAYER + " SELECT event_id, proof FROM proofs WHERE operation_type = 'UPDATE'")
def update_proofs(j: DataFrame) -> DataFrame:
    met = targets.resolved(_users(j).where("operation_type = 'UPDATE'"), _layer(j))
    return targets.proofs(met)


_TWINS = """
    , deletes AS (SELECT * FROM users WHERE operation_type = 'DELETE')
    , want AS (SELECT d.datasource_fingerprint, d.event_id, hex(d.geometry_wkb) AS shape, c.field, c.value FROM deletes d JOIN full_cells c USING (event_id) WHERE c.field <> 'id' AND c.value <> 'null')
    , pairs_met AS (SELECT w.event_id, r.row_fid, count(*) AS n, count(*) FILTER (WHERE c.value IS NOT DISTINCT FROM w.value) AS same
      FROM want w JOIN layer_rows r ON r.datasource_fingerprint = w.datasource_fingerprint AND r.shape = w.shape LEFT JOIN row_cells c ON c.datasource_fingerprint = r.datasource_fingerprint AND c.entity = r.entity AND c.field = w.field GROUP BY 1, 2)
    , twins AS (SELECT event_id, min(row_fid) AS twin_fid FROM pairs_met WHERE n = same GROUP BY 1)"""


@query("restore_twins", _LAYER + _TWINS + " SELECT event_id, twin_fid FROM twins")
def restore_twins(j: DataFrame) -> DataFrame:
    return targets.duplicates(_users(j).where("operation_type = 'DELETE'"), _layer(j), ("id",))


_RESTORES = (
    _LAYER
    + _TWINS
    + f"""
    , reasons AS (SELECT p.*, CASE operation_type
        WHEN 'DELETE' THEN CASE WHEN found_by = 'pk' THEN 'key_is_there' WHEN twin_fid IS NOT NULL THEN 'twin_is_there' ELSE 'inserted' END
        WHEN 'INSERT' THEN CASE WHEN target_fid IS NULL THEN 'target_is_gone' WHEN found_by = 'pk' OR (shared > 0 AND new_apart = 0 AND (new_shape IS NULL OR row_shape IS NOT DISTINCT FROM new_shape)) THEN 'deleted' ELSE 'only_the_number_matches' END
        ELSE CASE WHEN target_fid IS NULL THEN 'target_absent' WHEN shared = n AND old_apart = 0 AND (old_shape IS NULL OR row_shape IS NOT DISTINCT FROM old_shape) AND (n > 0 OR old_shape IS NOT NULL) THEN 'already_at_old'
          WHEN proof IN ('pk', 'post_geometry', 'post_attributes') THEN 'taken_back' ELSE proof END END AS reason
      FROM proofs p LEFT JOIN twins USING (event_id))
    , restores AS (SELECT *, CASE WHEN reason IN ('inserted', 'taken_back') AND datasource_fingerprint = '{LOST[0]}' AND event_id IN (SELECT event_id FROM sides WHERE field = '{LOST[1]}') THEN 'applied_partial'
        WHEN reason IN ('inserted', 'deleted', 'taken_back') THEN 'applied' WHEN reason IN ('key_is_there', 'twin_is_there', 'target_is_gone', 'already_at_old') THEN 'skipped_idempotent'
        WHEN reason = 'geometry_mismatch' THEN 'failed_geometry_drift' ELSE 'failed_target_absent' END AS outcome FROM reasons)"""
)


def _restores(j: DataFrame) -> DataFrame:
    lost = j.sparkSession.createDataFrame([LOST], "datasource_fingerprint string, field string")
    return targets.event_restores(_users(j), _layer(j), lost, ("id",))


@query("event_restores", _RESTORES + " SELECT event_id, target_fid, reason, outcome FROM restores")
def event_restores(j: DataFrame) -> DataFrame:
    return _restores(j).select("event_id", "target_fid", "reason", "outcome")


@query(
    "restore_sessions",
    _RESTORES
    + """, s AS (SELECT datasource_fingerprint, count(*) FILTER (WHERE outcome NOT LIKE 'failed%') AS n_ok, count(*) FILTER (WHERE outcome LIKE 'failed%') AS n_fail, count(*) AS n_requested FROM restores GROUP BY 1)
    SELECT *, CASE WHEN n_fail = 0 AND n_ok > 0 THEN 'completed' WHEN n_ok > 0 THEN 'partial' WHEN n_fail > 0 THEN 'failed' ELSE 'cancelled' END AS status FROM s""",
)
def restore_sessions(j: DataFrame) -> DataFrame:
    return targets.restore_session(_restores(j))


_CLAIMS = """
    , offers AS (SELECT r.datasource_fingerprint, r.row_fid, r.shape, a.value AS amount, k.value AS kind FROM layer_rows r
      JOIN row_cells a ON a.datasource_fingerprint = r.datasource_fingerprint AND a.entity = r.entity AND a.field = 'amount'
      JOIN row_cells k ON k.datasource_fingerprint = r.datasource_fingerprint AND k.entity = r.entity AND k.field = 'kind')
    , wants AS (SELECT u.event_id, u.datasource_fingerprint, u.created_at, hex(u.geometry_wkb) AS shape, a.value AS amount, k.value AS kind FROM users u
      JOIN full_cells a ON a.event_id = u.event_id AND a.field = 'amount' JOIN full_cells k ON k.event_id = u.event_id AND k.field = 'kind' WHERE operation_type = 'DELETE')
    , claimed AS (SELECT w.event_id, o.row_fid FROM
        (SELECT *, row_number() OVER (PARTITION BY datasource_fingerprint, shape, amount, kind ORDER BY created_at DESC, event_id DESC) AS n FROM wants) w
        JOIN (SELECT *, row_number() OVER (PARTITION BY datasource_fingerprint, shape, amount, kind ORDER BY row_fid) AS n FROM offers) o USING (datasource_fingerprint, shape, amount, kind, n))"""


@query("twin_claims", _LAYER + _CLAIMS + " SELECT event_id, row_fid AS fid FROM claimed")
def twin_claims(j: DataFrame) -> DataFrame:
    return claims.claimed_twins(_users(j).where("operation_type = 'DELETE'"), _layer(j), ("id",)).select("event_id", "fid")


#: One event after another, each on the row as the last one left it.
_SEQUENCE = (
    _CLAIMS
    + """
    , behind AS (SELECT f.*, c.row_fid AS twin, last_value(CASE WHEN bare AND operation_type = 'DELETE' THEN f.event_id END IGNORE NULLS) OVER w AS gone,
        last_value(CASE WHEN bare AND operation_type = 'DELETE' THEN coalesce(c.row_fid, -1) END IGNORE NULLS) OVER w AS gone_twin
      FROM found f LEFT JOIN claimed c USING (event_id)
      WINDOW w AS (PARTITION BY datasource_fingerprint, no, bare ORDER BY created_at DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    , slotted AS (SELECT *, CASE WHEN NOT bare THEN CASE WHEN target_fid IS NOT NULL THEN 'row:' || target_fid ELSE 'key:id:' || no END WHEN operation_type = 'DELETE' THEN 'new:' || event_id
        WHEN gone_twin >= 0 THEN 'row:' || gone_twin WHEN gone IS NOT NULL THEN 'new:' || gone WHEN target_fid IS NOT NULL THEN 'row:' || target_fid ELSE 'fid:' || no END AS slot FROM behind)
    , sided AS (SELECT event_id, map(list(field), list(old)) AS old, map(list(field), list(new)) AS new FROM sides GROUP BY 1)
    , steps AS (SELECT s.event_id, s.datasource_fingerprint, slot, operation_type AS op, bare, twin, hex(geometry_wkb) AS old_shape, hex(new_geometry_wkb) AS new_shape, coalesce(old, MAP {}) AS old, coalesce(new, MAP {}) AS new,
        row_number() OVER (PARTITION BY s.datasource_fingerprint, slot ORDER BY created_at DESC, s.event_id DESC) AS k FROM slotted s LEFT JOIN sided USING (event_id))
    , held AS (SELECT r.datasource_fingerprint, 'row:' || row_fid AS slot, any_value(r.shape) AS shape, map(list(c.field) FILTER (WHERE c.field IS NOT NULL), list(c.value) FILTER (WHERE c.field IS NOT NULL)) AS attrs
      FROM layer_rows r LEFT JOIN row_cells c USING (datasource_fingerprint, entity) GROUP BY 1, 2)
    , run AS (
      SELECT s.datasource_fingerprint, s.slot, 0::BIGINT AS k, h.slot IS NOT NULL AS present, h.attrs, h.shape, NULL::BIGINT AS event_id, NULL::VARCHAR AS reason
      FROM (SELECT DISTINCT datasource_fingerprint, slot FROM steps) s LEFT JOIN held h USING (datasource_fingerprint, slot)
      UNION ALL
      SELECT datasource_fingerprint, slot, k, CASE reason WHEN 'inserted' THEN true WHEN 'deleted' THEN false ELSE present END,
        CASE reason WHEN 'inserted' THEN old WHEN 'taken_back' THEN map_from_entries(list_transform(map_entries(attrs), lambda e: {'key': e.key, 'value': CASE WHEN map_contains(old, e.key) THEN old[e.key] ELSE e.value END})) ELSE attrs END,
        CASE WHEN reason = 'inserted' THEN old_shape WHEN reason = 'taken_back' THEN coalesce(old_shape, shape) ELSE shape END, event_id, reason
      FROM (SELECT *, CASE op WHEN 'DELETE' THEN CASE WHEN present THEN 'key_is_there' WHEN twin IS NOT NULL THEN 'twin_is_there' ELSE 'inserted' END
          WHEN 'INSERT' THEN CASE WHEN NOT present THEN 'target_is_gone' WHEN NOT bare OR (new_there > 0 AND new_same = new_there AND (new_shape IS NULL OR new_shape IS NOT DISTINCT FROM shape)) THEN 'deleted' ELSE 'only_the_number_matches' END
          ELSE CASE WHEN NOT present THEN 'target_absent' WHEN old_same = cardinality(old) AND (old_shape IS NULL OR old_shape IS NOT DISTINCT FROM shape) AND (cardinality(old) > 0 OR old_shape IS NOT NULL) THEN 'already_at_old'
            WHEN NOT bare THEN 'taken_back' WHEN new_shape IS NOT NULL THEN CASE WHEN new_shape IS NOT DISTINCT FROM shape THEN 'taken_back' ELSE 'geometry_mismatch' END
            WHEN cardinality(new) = 0 THEN 'nothing_captured' WHEN new_there = 0 THEN 'nothing_to_compare' WHEN new_same = new_there THEN 'taken_back' ELSE 'attribute_mismatch' END END AS reason
        FROM (SELECT r.datasource_fingerprint, r.slot, r.present, r.attrs, r.shape, s.k, s.event_id, s.op, s.bare, s.twin, s.old, s.new, s.old_shape, s.new_shape,
            len(list_filter(map_keys(s.new), lambda f: map_contains(r.attrs, f))) AS new_there,
            len(list_filter(map_keys(s.new), lambda f: map_contains(r.attrs, f) AND r.attrs[f] IS NOT DISTINCT FROM s.new[f])) AS new_same,
            len(list_filter(map_keys(s.old), lambda f: map_contains(r.attrs, f) AND r.attrs[f] IS NOT DISTINCT FROM s.old[f])) AS old_same
          FROM run r JOIN steps s ON s.datasource_fingerprint = r.datasource_fingerprint AND s.slot = r.slot AND s.k = r.k + 1))
    )"""
)


def _sequence(j: DataFrame) -> tuple[DataFrame, sequence.Restored]:
    rows = _layer(j)
    return rows, sequence.restored(_users(j), rows, ("id",))


#: The ladder of proofs for inserts and updates; ``stages`` has (event_id, target_fid, stage).
_STAGES = """
    , told AS (SELECT event_id, field, new AS value FROM sides WHERE field <> 'id' AND new IS NOT NULL AND new <> 'null')
    , telling AS (SELECT event_id, count(*) AS n FROM told GROUP BY 1)
    , ins0 AS (SELECT p.*, hex(geometry_wkb) AS drawn FROM proofs p WHERE operation_type = 'INSERT')
    , ins1 AS (SELECT * FROM ins0 WHERE found_by IS DISTINCT FROM 'pk' AND NOT (found_by IS NOT DISTINCT FROM 'fid' AND old_apart = 0 AND (drawn IS NULL OR row_shape IS NOT DISTINCT FROM drawn)))
    , alike AS (SELECT e.event_id, r.row_fid, r.shape, count(*) AS same FROM (SELECT DISTINCT event_id, datasource_fingerprint FROM proofs WHERE operation_type <> 'DELETE') e JOIN told t USING (event_id)
      JOIN row_cells c ON c.datasource_fingerprint = e.datasource_fingerprint AND c.field = t.field AND c.value = t.value JOIN layer_rows r ON r.datasource_fingerprint = c.datasource_fingerprint AND r.entity = c.entity GROUP BY ALL)
    , snap AS (SELECT i.event_id, max(a.row_fid) AS fid FROM ins1 i JOIN telling USING (event_id) JOIN alike a ON a.event_id = i.event_id AND a.same = telling.n AND (i.drawn IS NULL OR a.shape IS NOT DISTINCT FROM i.drawn) GROUP BY 1)
    , ins2 AS (SELECT * FROM ins1 WHERE event_id NOT IN (SELECT event_id FROM snap))
    , few_shapes AS (SELECT datasource_fingerprint, shape FROM layer_rows WHERE shape IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 5)
    , differing AS (SELECT i.event_id, r.row_fid, coalesce(string_agg(t.field, ',' ORDER BY t.field) FILTER (WHERE c.field IS NOT NULL AND c.value IS DISTINCT FROM t.value), '') AS apart
      FROM ins2 i JOIN few_shapes s ON s.datasource_fingerprint = i.datasource_fingerprint AND s.shape = i.drawn JOIN layer_rows r ON r.datasource_fingerprint = s.datasource_fingerprint AND r.shape = s.shape
      LEFT JOIN told t ON t.event_id = i.event_id LEFT JOIN row_cells c ON c.datasource_fingerprint = r.datasource_fingerprint AND c.entity = r.entity AND c.field = t.field GROUP BY 1, 2)
    , but_one AS (SELECT event_id, max(row_fid) AS fid FROM differing GROUP BY 1 HAVING count(DISTINCT apart) = 1 AND min(apart) <> '' AND min(apart) NOT LIKE '%,%')
    , ins3 AS (SELECT * FROM ins2 WHERE event_id NOT IN (SELECT event_id FROM but_one))
    , by_values AS (SELECT i.event_id, min(a.row_fid) AS fid FROM ins3 i JOIN telling USING (event_id) JOIN alike a ON a.event_id = i.event_id AND a.same = telling.n WHERE telling.n >= 2 GROUP BY 1 HAVING count(*) = 1)
    , ins4 AS (SELECT * FROM ins3 WHERE event_id NOT IN (SELECT event_id FROM by_values))
    , upd1 AS (SELECT * FROM proofs WHERE operation_type = 'UPDATE' AND proof NOT IN ('pk', 'post_geometry', 'post_attributes'))
    , near_rows AS (SELECT u.event_id, r.row_fid FROM upd1 u LEFT JOIN telling USING (event_id) JOIN layer_rows r ON r.datasource_fingerprint = u.datasource_fingerprint AND r.shape = u.new_shape
        LEFT JOIN alike a ON a.event_id = u.event_id AND a.row_fid = r.row_fid WHERE u.new_shape IS NOT NULL AND coalesce(a.same, 0) = coalesce(telling.n, 0)
      UNION ALL SELECT u.event_id, a.row_fid FROM upd1 u JOIN telling USING (event_id) JOIN alike a ON a.event_id = u.event_id AND a.same = telling.n WHERE u.new_shape IS NULL AND telling.n >= 2)
    , elsewhere AS (SELECT event_id, min(row_fid) AS fid FROM near_rows GROUP BY 1 HAVING count(*) = 1)
    , upd2 AS (SELECT * FROM upd1 WHERE event_id NOT IN (SELECT event_id FROM elsewhere))
    , stages AS (
      SELECT event_id, target_fid, 'key' AS stage FROM proofs WHERE operation_type <> 'DELETE' AND found_by = 'pk'
      UNION ALL SELECT event_id, target_fid, 'number' FROM ins0 WHERE found_by IS DISTINCT FROM 'pk' AND event_id NOT IN (SELECT event_id FROM ins1)
      UNION ALL SELECT event_id, fid, 'snapshot' FROM snap UNION ALL SELECT event_id, fid, 'but_one' FROM but_one UNION ALL SELECT event_id, fid, 'values' FROM by_values
      UNION ALL SELECT i.event_id, CASE WHEN shares THEN target_fid END, CASE WHEN target_fid IS NULL THEN 'absent' WHEN shares THEN 'evidence' ELSE 'gone' END
        FROM (SELECT i.*, coalesce(i.drawn = i.row_shape, false) OR a.event_id IS NOT NULL AS shares FROM ins4 i LEFT JOIN alike a ON a.event_id = i.event_id AND a.row_fid = i.target_fid) i
      UNION ALL SELECT event_id, target_fid, 'number' FROM proofs WHERE operation_type = 'UPDATE' AND proof IN ('post_geometry', 'post_attributes')
      UNION ALL SELECT event_id, fid, 'elsewhere' FROM elsewhere
      UNION ALL SELECT event_id, NULL, CASE WHEN target_fid IS NULL THEN 'absent' WHEN shared = n AND old_apart = 0 AND (old_shape IS NULL OR row_shape IS NOT DISTINCT FROM old_shape) AND (n > 0 OR old_shape IS NOT NULL) THEN 'already_at_old' ELSE 'unproven' END FROM upd2)"""


@query("proof_stages", _LAYER + _STAGES + " SELECT event_id, target_fid, stage FROM stages")
def proof_stages(j: DataFrame) -> DataFrame:
    events, rows = settled(_users(j)), _layer(j)
    return ladder.removals(events, rows, ("id",)).unionByName(ladder.updates(events, rows, ("id",)))


#: Numbers whose first event of the sequence finds its row under another number, which all of them follow.
_RELOCATED = (
    _STAGES
    + """
    , heads AS (SELECT event_id, datasource_fingerprint, no FROM users WHERE bare QUALIFY row_number() OVER (PARTITION BY datasource_fingerprint, no ORDER BY created_at DESC, event_id DESC) = 1)
    , moved AS (SELECT h.datasource_fingerprint, h.no, s.target_fid AS moved_fid FROM heads h JOIN stages s USING (event_id) WHERE s.stage IN ('snapshot', 'but_one', 'values', 'elsewhere')
      QUALIFY row_number() OVER (PARTITION BY h.datasource_fingerprint, s.target_fid ORDER BY event_id) = 1)"""
    + _SEQUENCE.replace("FROM found f LEFT JOIN claimed c", "FROM (SELECT f.* REPLACE (CASE WHEN bare THEN coalesce(m.moved_fid, f.target_fid) ELSE f.target_fid END AS target_fid) FROM found f LEFT JOIN moved m USING (datasource_fingerprint, no)) f LEFT JOIN claimed c")
)


@query("restores_of_moved_rows", _LAYER + _RELOCATED + " SELECT event_id, slot, reason FROM run WHERE k > 0")
def restores_of_moved_rows(j: DataFrame) -> DataFrame:
    done = sequence.restored(settled(_users(j)), _layer(j), ("id",), relocate=True).events
    return done.select("event_id", F.translate("slot", "\u0001", ":").alias("slot"), "reason")


@query("restores_in_sequence", _LAYER + _SEQUENCE + " SELECT event_id, slot, reason FROM run WHERE k > 0")
def restores_in_sequence(j: DataFrame) -> DataFrame:
    done = _sequence(j)[1].events
    return done.select("event_id", F.translate("slot", "\u0001", ":").alias("slot"), "reason")


@query(
    "rows_after_sequence",
    _LAYER
    + _SEQUENCE
    + """, ends AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY datasource_fingerprint, slot ORDER BY k DESC) = 1)
    , every AS (SELECT datasource_fingerprint, slot, attrs, shape FROM ends WHERE present UNION ALL SELECT datasource_fingerprint, slot, attrs, shape FROM held WHERE (datasource_fingerprint, slot) NOT IN (SELECT datasource_fingerprint, slot FROM ends))
    SELECT datasource_fingerprint, slot, coalesce(array_to_string(list_sort(list_transform(map_entries(attrs), lambda e: e.key || '=' || coalesce(e.value, 'null'))), ';'), '') AS attributes, shape FROM every""",
)
def rows_after_sequence(j: DataFrame) -> DataFrame:
    rows, done = _sequence(j)
    left = sequence.rows_after(rows, done)
    attributes = F.coalesce(payload.as_text("attributes"), F.lit(""))
    return left.select("datasource_fingerprint", F.translate("slot", "\u0001", ":").alias("slot"), attributes.alias("attributes"), F.hex("geometry_wkb").alias("shape"))


@query(
    "session_undo",
    _LAYER.replace("users AS (SELECT *, CAST(feature_identity_json->>'fid' AS BIGINT) AS no, event_id % 3 = 0 AS bare FROM keyed WHERE ref IS NULL)",
                   f"users AS (SELECT *, CAST(feature_identity_json->>'fid' AS BIGINT) AS no, false AS bare FROM keyed WHERE ref IS NULL AND session_id = 's7-{AT[:10]}')")
    + _SEQUENCE
    + " SELECT r.event_id, reason, row_number() OVER (ORDER BY created_at, r.event_id) AS step FROM run r JOIN journal j ON j.event_id = r.event_id WHERE k > 0",
)
def session_undo(j: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    out = sequence.session_undo(j, f"s7-{AT[:10]}", _layer(j), ("id",)).events
    return out.select("event_id", "reason", F.row_number().over(Window.orderBy("created_at", "event_id")).alias("step"))  # one session's events


@query(
    "content_matches",
    _LAYER
    + """
    , want_all AS (SELECT event_id, field, value FROM full_cells WHERE value <> 'null' UNION ALL SELECT event_id, field, new FROM delta_cells WHERE field <> 'updated_at' AND new <> 'null')
    , wanted AS (SELECT k.event_id, k.datasource_fingerprint, hex(coalesce(k.new_geometry_wkb, k.geometry_wkb)) AS shape, count(w.field) AS n FROM keyed k LEFT JOIN want_all w USING (event_id) GROUP BY ALL)
    , near AS (SELECT w.event_id, s.datasource_fingerprint, s.entity, w.n FROM wanted w JOIN state s ON s.datasource_fingerprint = w.datasource_fingerprint AND s.shape = w.shape
      UNION ALL SELECT w.event_id, s.datasource_fingerprint, s.entity, w.n FROM wanted w JOIN state s USING (datasource_fingerprint) WHERE w.shape IS NULL AND w.n >= 2)
    , held AS (SELECT c.event_id, c.entity FROM near c LEFT JOIN want_all w USING (event_id) LEFT JOIN row_cells x ON x.datasource_fingerprint = c.datasource_fingerprint AND x.entity = c.entity AND x.field = w.field
      GROUP BY c.event_id, c.entity, c.n HAVING count(*) FILTER (WHERE w.field IS NOT NULL AND x.value IS NOT DISTINCT FROM w.value) = c.n)
    SELECT event_id, min(entity) AS entity FROM held GROUP BY 1 HAVING count(*) = 1""",
)
def content_matches(j: DataFrame) -> DataFrame:
    return applying.content_matches(j, snapshot.state_at(j, LATER))


@query(
    "near_shapes",
    _state_sql(LATER)
    + """, e AS (SELECT event_id, datasource_fingerprint, hex(coalesce(new_geometry_wkb, geometry_wkb)) AS shape FROM journal WHERE coalesce(new_geometry_wkb, geometry_wkb) IS NOT NULL AND event_id % 3 > 0)
    SELECT event_id, count(*) AS n_rows, min(CAST(regexp_extract(entity, '=(\\d+)', 1) AS BIGINT)) AS lowest FROM e JOIN state USING (datasource_fingerprint, shape) GROUP BY 1""",
)
def near_shapes(j: DataFrame) -> DataFrame:
    """Events whose geometry is a last bit away from what was captured, or for each third of them far more, against the rows."""
    drawn = F.hex(F.coalesce("new_geometry_wkb", "geometry_wkb"))
    moved = F.when(F.col("event_id") % 3 == 0, F.overlay(drawn, F.lit("3F41"), 23, 4)).otherwise(F.overlay(drawn, F.lit("01"), 11, 2))
    events = j.select("datasource_fingerprint", "event_id", F.unhex(moved).alias("geometry_wkb"))
    rows = snapshot.state_at(j, LATER).select("datasource_fingerprint", F.regexp_extract("entity", r"=(\d+)", 1).cast("long").alias("fid"), "geometry_wkb")
    return shapes.matches(events, settled(rows))
