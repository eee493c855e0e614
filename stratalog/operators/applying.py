"""Applying and undoing compensations on a state, as new tables.

A state has a row per entity: datasource_fingerprint, entity, attributes (field -> JSON text), geometry_wkb. Applying never
changes it: it gives a new state, and an outcome for every action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog import session
from stratalog.functions import payload
from stratalog.operators import claims
from stratalog.operators.planning import judged
from stratalog.sources.journal import JOURNAL, is_active, is_trace, order_key

KEYS = ["datasource_fingerprint", "entity"]
#: Outcomes, and whether they count as done, skipped or failed.
OUTCOMES = {
    "applied": "ok", "applied_partial": "ok", "skipped_idempotent": "skipped", "failed": "fail", "failed_target_absent": "fail",
    "failed_geometry_drift": "fail", "rolled_back": "fail",
}
HARD = ("failed",)


def _holds(now: Column, wanted: Column) -> Column:
    """Whether a state has all the wanted values."""
    return F.forall(F.map_entries(wanted), lambda e: F.element_at(now, e["key"]).eqNullSafe(e["value"]) & F.map_contains_key(now, e["key"]))


def update_targets(plan: DataFrame) -> DataFrame:
    """Where the updates of a plan lead, per entity: ``_old`` (field -> its oldest old value), ``_move.g`` (oldest shape)."""
    k, updates = order_key(), plan.where("compensation = 'UPDATE'")
    shapes = updates.groupBy(*KEYS).agg(F.min_by(F.struct(F.col("geometry_wkb").alias("g")), F.when(F.col("geometry_wkb").isNotNull(), k)).alias("_move"))
    cells = updates.select(*KEYS, k.alias("k"), F.explode(payload.changes()).alias("field", "v"))
    cells = cells.groupBy(*KEYS, "field").agg(F.min_by(F.struct("v.old"), "k").alias("o"))
    cells = cells.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("field", "o.old"))).alias("_old"))
    return shapes.join(cells, KEYS, "left")


def outcomes(state: DataFrame, events: DataFrame, refused: DataFrame | None = None, lost: DataFrame | None = None) -> DataFrame:
    """The actions of ``events`` (with ``entity``) and the ``outcome`` of each against ``state``.

    ``refused(event_id)`` are actions whose write the source turned down: they fail, hard. ``lost`` (datasource_fingerprint,
    field) are fields that can't be written: an action that would write one is applied in part.

    An insert is needed unless the entity is there, a delete unless it is gone. Updates are needed unless the entity has
    all the values that they lead to, and refused where it is gone (and no action of the plan brings it back) or where its
    geometry, once the newer updates are undone, is neither the update's new one nor its old one.
    """
    plan = session.settled(judged(events).where("compensation IS NOT NULL"))  # read four times
    now = state.select(*KEYS, F.col("geometry_wkb").alias("_shape"), F.lit(True).alias("_there"))
    brought = plan.where("compensation = 'INSERT'").select(*KEYS).distinct().withColumn("_brought", F.lit(True))
    # What updates lead to is compared once for an entity; its values aren't carried to each event.
    none = F.create_map().cast("map<string,string>")
    leads = update_targets(plan).join(state.select(*KEYS, "attributes", F.col("geometry_wkb").alias("_at")), KEYS, "left")
    holds = _holds(F.coalesce("attributes", none), F.coalesce("_old", none)) & (F.col("_move").isNull() | F.col("_at").eqNullSafe(F.col("_move.g")))
    leads = leads.select(*KEYS, holds.alias("_settled"), *([] if lost is None else [F.map_keys(F.coalesce("_old", none)).alias("_written")]))
    met = plan.join(now, KEYS, "left").join(brought, KEYS, "left").join(leads, KEYS, "left")
    there, coming = F.coalesce("_there", F.lit(False)), F.coalesce("_brought", F.lit(False))
    moved = (F.col("compensation") == "UPDATE") & F.col("geometry_wkb").isNotNull()
    newer = Window.partitionBy(*KEYS).orderBy("created_at", "event_id").rowsBetween(1, Window.unboundedFollowing)
    met = met.withColumn("_then", F.coalesce(F.first(F.when(moved, F.col("geometry_wkb")), ignorenulls=True).over(newer), F.col("_shape")))
    drift = moved & ~F.col("_then").eqNullSafe(F.col("new_geometry_wkb")) & ~F.col("_then").eqNullSafe(F.col("geometry_wkb"))
    outcome = (
        F.when(F.col("compensation") == "INSERT", F.when(there, "skipped_idempotent").otherwise("applied"))
        .when(F.col("compensation") == "DELETE", F.when(there | coming, "applied").otherwise("skipped_idempotent"))
        .when(coming & ~there, "applied")
        .when(~there, "failed_target_absent")
        .when(F.col("_settled"), "skipped_idempotent")
        .when(drift, "failed_geometry_drift")
        .otherwise("applied")
    )
    if lost is not None:
        gone = lost.groupBy("datasource_fingerprint").agg(F.collect_set("field").alias("_lost"))  # fields of a source
        met = met.join(gone, "datasource_fingerprint", "left")
        written = F.when(F.col("compensation") == "UPDATE", F.col("_written")).when(F.col("compensation") == "INSERT", F.map_keys(F.coalesce(payload.full_attributes(), none)))
        partial = F.coalesce(F.arrays_overlap(written, F.col("_lost")), F.lit(False))
        outcome = F.when((outcome == "applied") & partial, "applied_partial").otherwise(outcome)
    if refused is not None:
        met = met.join(refused.select("event_id", F.lit(True).alias("_refused")).distinct(), "event_id", "left")
        outcome = F.when(F.col("_refused") & ~outcome.startswith("skipped"), "failed").otherwise(outcome)
    return met.withColumn("outcome", outcome).select(*plan.columns, "outcome")


def rolled_back(decided: DataFrame) -> DataFrame:
    """``decided`` as a strict run reports it: in a source with a hard failure nothing was applied.

    Actions that were refused or found nothing to do keep their outcome; the others of such a source are ``rolled_back``.
    Targets that are gone or have drifted are soft failures: the run goes on.
    """
    broken = decided.where(F.col("outcome").isin(*HARD)).select("datasource_fingerprint").distinct().withColumn("_broken", F.lit(True))
    met = decided.join(F.broadcast(broken), "datasource_fingerprint", "left")  # a name a source
    undone = F.coalesce("_broken", F.lit(False)) & F.col("outcome").isin("applied", "applied_partial")
    return met.withColumn("outcome", F.when(undone, "rolled_back").otherwise(F.col("outcome"))).select(*decided.columns)


def apply_plan(state: DataFrame, decided: DataFrame, strict: bool = True) -> DataFrame:
    """The state after the ``applied`` actions of ``decided``; with ``strict``, a source with a hard failure keeps its rows.

    Actions of one entity run insert, updates from the newest to the oldest, delete; so of each field the oldest old value
    holds in the end, and the aggregate of an entity combines on the map side.
    """
    done = decided.where(F.col("outcome").isin("applied", "applied_partial"))
    if strict:
        done = rolled_back(decided).where(F.col("outcome").isin("applied", "applied_partial"))
    k, c = order_key(), F.col("compensation")
    whole = done.groupBy(*KEYS).agg(
        F.max(c == "DELETE").alias("_delete"),
        F.min_by(F.struct(payload.full_attributes().alias("a"), F.col("geometry_wkb").alias("g")), F.when(c == "INSERT", k)).alias("_insert"),
    )
    met = state.select(*KEYS, "attributes", "geometry_wkb", F.lit(True).alias("_there")).join(whole, KEYS, "full_outer").join(update_targets(done), KEYS, "left")
    none = F.create_map().cast("map<string,string>")
    base = F.coalesce(F.when(F.col("_there"), F.col("attributes")), F.col("_insert.a"), none)
    old = F.coalesce("_old", none)
    attributes = F.map_concat(F.map_filter(base, lambda f, _: ~F.map_contains_key(old, f)), old)
    shape = F.when(F.col("_move").isNotNull(), F.col("_move.g")).otherwise(F.coalesce("geometry_wkb", "_insert.g"))
    left = met.where((F.col("_there") | F.col("_insert").isNotNull()) & ~F.coalesce("_delete", F.lit(False)))
    return left.select(*KEYS, F.when(F.size(attributes) > 0, attributes).alias("attributes"), shape.alias("geometry_wkb"))


def traces_of(decided: DataFrame, now: str, user: str, last_id: int = 0) -> DataFrame:
    """The trace events that record what was applied, numbered after ``last_id``."""
    done = decided.where(F.col("outcome").isin("applied", "applied_partial"))
    marker = F.concat(F.lit('{"_restore_ref": '), F.col("event_id").cast("string"), F.lit("}"))
    changed = {
        "event_id": F.lit(last_id) + 1 + F.monotonically_increasing_id(),
        "operation_type": F.col("compensation"),
        "attributes_json": marker,
        "geometry_wkb": F.lit(None).cast("binary"),
        "new_geometry_wkb": F.lit(None).cast("binary"),
        "user_name": F.lit(user),
        "session_id": F.lit(None).cast("string"),
        "created_at": F.lit(now),
        "restored_from_event_id": F.col("event_id"),
        "invalidated_at": F.lit(None).cast("string"),
    }
    return done.select(*[changed.get(c, F.col(c)).alias(c) for c in JOURNAL.names])


def invalidated(journal: DataFrame, undone: DataFrame, now: str) -> DataFrame:
    """The journal with the active traces of the events ``undone(event_id)`` invalidated."""
    ids = undone.select(F.col("event_id").alias("restored_from_event_id"), F.lit(True).alias("_undone")).distinct()
    met = journal.join(ids, "restored_from_event_id", "left")
    stamp = F.when(is_trace() & is_active() & F.col("_undone"), F.lit(now)).otherwise(F.col("invalidated_at"))
    return met.select(*[stamp.alias(c) if c == "invalidated_at" else F.col(c) for c in journal.columns])


def inverse_events(events: DataFrame) -> DataFrame:
    """Events turned round, so that applying their compensations undoes the compensations of ``events``."""
    op = F.col("operation_type")
    delta = payload.inverted(payload.changes())
    changed = {
        "operation_type": F.when(op == "INSERT", "DELETE").when(op == "DELETE", "INSERT").otherwise(op),
        "attributes_json": F.when(op == "UPDATE", payload.to_payload(F.coalesce(delta, F.create_map().cast("map<string,struct<old:string,new:string>>")))).otherwise(F.col("attributes_json")),
        "geometry_wkb": F.when(op == "UPDATE", F.col("new_geometry_wkb")).otherwise(F.col("geometry_wkb")),
        "new_geometry_wkb": F.when(op == "UPDATE", F.col("geometry_wkb")).otherwise(F.col("new_geometry_wkb")),
    }
    return events.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in events.columns])


def outcome_counts(decided: DataFrame) -> DataFrame:
    """One row per source: each outcome's count, apply_ok, apply_skipped, apply_fail, and plan_actions, their sum."""
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    known = F.col("outcome").isin(*OUTCOMES)
    out = decided.groupBy("datasource_fingerprint").agg(*each, F.count("*").alias("plan_actions"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))
    sums = {f"apply_{k}": sum((F.col(o) for o, v in OUTCOMES.items() if v == k), F.lit(0)) for k in ("ok", "skipped", "fail")}
    return out.withColumns(sums)


def conserved(counts: DataFrame) -> DataFrame:
    """``outcome_counts`` with ``holds``: outcomes add up to the plan. An outcome that is none of ``OUTCOMES`` breaks it."""
    return counts.withColumn("holds", F.col("apply_ok") + F.col("apply_skipped") + F.col("apply_fail") == F.col("plan_actions"))


def row_count_check(before: DataFrame, after: DataFrame, decided: DataFrame) -> DataFrame:
    """Per source: rows expected to come (applied inserts less deletes) and rows that did."""
    done = F.col("outcome").isin("applied", "applied_partial")
    due = decided.groupBy("datasource_fingerprint").agg(
        (F.count_if(done & (F.col("compensation") == "INSERT")) - F.count_if(done & (F.col("compensation") == "DELETE"))).alias("expected")
    )
    was = before.groupBy("datasource_fingerprint").agg(F.count("*").alias("was"))
    now = after.groupBy("datasource_fingerprint").agg(F.count("*").alias("now"))
    met = due.join(was, "datasource_fingerprint", "left").join(now, "datasource_fingerprint", "left")
    came = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    return met.select("datasource_fingerprint", "expected", came.alias("measured"), (F.col("expected") == came).alias("holds"))


def content_matches(events: DataFrame, state: DataFrame, least: int = 2) -> DataFrame:
    """(event_id, entity): the one row of the state that has the event's geometry and all its new values.

    Events and rows meet on a digest of all that is compared (``claims``); events without geometry need ``least`` values. An
    event with several such rows has none.
    """
    new, shape = payload.new_attributes(), F.coalesce("new_geometry_wkb", "geometry_wkb")
    drawn, bare = events.where(shape.isNotNull()), events.where(shape.isNull())
    want = claims.wanted(drawn, (), new, shape, 0).unionByName(claims.wanted(bare, (), new, shape, least))
    rows = state.select("datasource_fingerprint", F.col("entity").alias("fid"), "attributes", "geometry_wkb")
    return claims.matched(want, rows).where("n = 1").select("event_id", F.col("lowest").alias("entity"))
