"""The state of every entity as of an instant.

A chain of events is never gathered: what an entity is at T is a set of "latest by time" values, which combine on the map
side. Its operation is that of its last event; each field has the value of the last event that writes it; its geometry is
that of the last event that sets one. So an entity with any number of events costs its tasks no memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import geometry, identity, moments, payload
from stratalog.session import settled
from stratalog.sources.journal import is_active, is_trace, order_key

KEYS = ["datasource_fingerprint", "entity"]


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("entity", identity.entity_key())


PLACED = [*KEYS, "event_id", "created_at", "operation_type", "restored_from_event_id"]


def _sources(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, user events that a trace refers to): keys, place in time, and whether they have a full payload or a shape."""
    has = {"has_full": payload.full_attributes().isNotNull(), "has_shape": F.col("geometry_wkb").isNotNull()}
    traces = keyed(events.where(is_trace())).select(*PLACED, *[v.alias(k) for k, v in has.items()])
    refs = traces.select(F.col("restored_from_event_id").alias("event_id")).distinct()
    users = keyed(events.where(~is_trace()).join(refs, "event_id", "left_semi"))
    return traces, users.select(*PLACED, *[v.alias(k) for k, v in has.items()])


def _usable_links(traces: DataFrame, sources: DataFrame) -> DataFrame:
    """Traces with their source (``s_...``), where that is there, of their entity and earlier in time."""
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    same = [F.col(k) == F.col(f"s_{k}") for k in KEYS]
    return traces.join(s, (F.col("restored_from_event_id") == F.col("s_event_id")) & same[0] & same[1] & (order_key("s_") < order_key()))


def trace_origins(events: DataFrame) -> DataFrame:
    """One row per trace: event_id, body_id, turned, delta_only, shape_id, moved_id, missing.

    A trace that inserts or deletes takes its source's payload and geometry; one that updates takes the source's delta
    turned round, and its old geometry as the new one. ``body_id`` is the event whose payload that is in the end (only its
    delta if ``delta_only``, turned round if ``turned``), ``shape_id`` and ``moved_id`` those whose geometries are the
    trace's old and new one. A source that comes later, is of another entity or has nothing to take leaves the trace as it
    is, with ``missing`` set.

    Traces of traces are resolved round by round, the oldest first; the rounds are the longest chain of such links. All of
    it runs on ids: no payload or geometry is in any row.
    """
    traces, users = _sources(events)
    traces = settled(traces)
    own = {"body_id": F.col("event_id"), "turned": F.lit(False), "delta_only": F.lit(False), "shape_id": F.col("event_id")}
    alone = {**own, "moved_id": F.lit(None).cast("long"), "missing": F.lit(True)}
    links = settled(_usable_links(traces.select(*PLACED), users.select(*PLACED).unionByName(traces.select(*PLACED))).select("event_id", "s_event_id"))
    waiting = traces.join(links, "event_id", "left_semi")
    done = traces.join(links, "event_id", "left_anti").withColumns(alone)
    known = users.withColumns(own).unionByName(done.drop("moved_id", "missing"))
    for _ in range(_rounds(links)):
        met = _usable_links(waiting, known)
        whole = F.col("operation_type").isin("INSERT", "DELETE")
        usable = ~whole | F.col("s_has_full") | F.col("s_has_shape")
        take = lambda c, at_whole, at_update: F.when(usable & whole, at_whole).when(usable, at_update).otherwise(own.get(c, F.col(c))).alias(c)
        resolved = met.select(
            *PLACED,
            take("has_full", F.col("s_has_full"), F.lit(False)),
            take("has_shape", F.col("s_has_shape"), F.col("has_shape")),
            take("body_id", F.col("s_body_id"), F.col("s_body_id")),
            take("turned", F.col("s_turned"), ~F.col("s_turned")),
            take("delta_only", F.col("s_delta_only"), F.lit(True)),
            take("shape_id", F.col("s_shape_id"), F.col("event_id")),
            F.when(usable & ~whole, F.col("s_shape_id")).alias("moved_id"),
            (~usable).alias("missing"),
        )
        waiting = waiting.join(resolved.select("event_id"), "event_id", "left_anti")
        known = resolved.drop("moved_id", "missing")
        done = done.unionByName(resolved)
    return done.select("event_id", "body_id", "turned", "delta_only", "shape_id", "moved_id", "missing")


def _rounds(links: DataFrame) -> int:
    """Rounds that resolve all traces of ``links`` (event_id, s_event_id): the length of the longest chain, 1 at least.

    Links go back in time, so there are no circles.
    """
    ends, rounds = links, 0
    while True:
        rounds += 1
        ends = links.join(ends.select(F.col("event_id").alias("s_event_id")), "s_event_id", "left_semi")
        if not ends.limit(1).count():
            return rounds


def effective_events(events: DataFrame) -> DataFrame:
    """Events with ``entity``, ``full`` (field -> JSON), ``delta`` (field -> old, new) and ``missing``; traces carry what they
    applied (``trace_origins``).

    User events never move: the traces and the events that they lead back to meet on ids, found on narrow columns first.
    """
    users = _with_payload(events.where(~is_trace())).withColumn("missing", F.lit(False))
    origins = settled(trace_origins(events))
    wanted = origins.select(F.explode(F.array_compact(F.array("body_id", "shape_id", "moved_id"))).alias("event_id")).distinct()
    found = settled(events.join(wanted, "event_id", "left_semi").select("event_id", "attributes_json", "geometry_wkb"))
    met = events.where(is_trace()).join(origins, "event_id")
    for column, part, name in (("body_id", "attributes_json", "b_json"), ("shape_id", "geometry_wkb", "b_shape"), ("moved_id", "geometry_wkb", "b_moved")):
        met = met.join(found.select(F.col("event_id").alias(column), F.col(part).alias(name)), column, "left")
    shown = _with_payload(met, "b_json")
    none = F.create_map().cast("map<string,struct<old:string,new:string>>")
    delta = F.when(F.col("turned"), payload.inverted(F.col("delta"))).otherwise(F.col("delta"))
    changed = {
        "geometry_wkb": F.col("b_shape"),
        "new_geometry_wkb": F.when(F.col("moved_id").isNotNull(), F.col("b_moved")).otherwise(F.col("new_geometry_wkb")),
        "full": F.when(~F.col("delta_only"), F.col("full")),
        "delta": F.when(F.col("delta_only"), F.coalesce(delta, none)).otherwise(F.col("delta")),
    }
    traces = shown.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in users.columns])
    return users.unionByName(traces)


def _with_payload(events: DataFrame, body: str = "attributes_json") -> DataFrame:
    return keyed(events).withColumns({"full": payload.full_attributes(body), "delta": payload.changes(body)})


def before(at: str) -> Column:
    """Events up to ``at``: not later as text, as the journal compares, nor as times.

    A bound without an offset is a prefix: in whole seconds, it stands before all events of its second. What can't be read
    as a time is not before anything.
    """
    return F.coalesce((F.col("created_at") <= F.lit(moments.normalised_cutoff(at))) & (moments.instant("created_at") <= moments.instant(F.lit(at))), F.lit(False))


def visible(events: DataFrame, at: str) -> DataFrame:
    """Events not invalidated and up to ``at``."""
    return events.where(is_active() & before(at))


def state_at(events: DataFrame, at: str) -> DataFrame:
    """One row per entity that exists at ``at``: datasource_fingerprint, entity, last_op, last_event_id, last_at, crs,
    attributes (field -> JSON text, null if none), geometry_wkb.

    A deleted entity has no row. Full payloads lie over what was known before and clear nothing; an update's old values
    stand where nothing newer is known. Columns of other names in ``events`` are ignored; an empty journal gives no rows.

    Plan: one pass. An event is dealt into cells, one for each field that it writes, one for its shape and one for itself;
    of each cell the latest wins, on the map side already, so values of earlier events are not shuffled.
    """
    cells = cells_of(visible(effective_events(events.where(is_active())), at))
    best = cells.groupBy(*KEYS, "kind", "field").agg(F.max_by(F.struct("value", "wkb", "crs", "k"), "k").alias("v"))
    return rows_of(best, KEYS)


def cells_of(seen: DataFrame) -> DataFrame:
    """``effective_events`` dealt into what they write: keys, ``k`` (place in time), ``kind`` (0 a field, 1 the shape, 2 the
    event itself), ``field``, ``value``, ``wkb``, ``crs``."""
    op = F.col("operation_type")
    shape = F.when(op == "INSERT", F.col("geometry_wkb")).when(op == "UPDATE", F.coalesce("new_geometry_wkb", "geometry_wkb"))
    sets_shape = (op == "INSERT") | ((op == "UPDATE") & shape.isNotNull())
    written = F.when(op.isin("INSERT", "DELETE"), F.col("full")).when(op == "UPDATE", F.transform_values("delta", lambda _, v: v["new"]))
    cell = lambda kind, field, value, wkb, crs: F.struct(kind.alias("kind"), field.alias("field"), value.alias("value"), wkb.alias("wkb"), crs.alias("crs"))
    no, none, nothing = F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("binary")
    fields = F.transform(F.map_entries(F.coalesce(written, F.create_map().cast("map<string,string>"))), lambda e: cell(F.lit(0), e["key"], e["value"], nothing, no))
    extra = F.array_compact(F.array(F.when(sets_shape, cell(F.lit(1), none, no, shape, no)), cell(F.lit(2), none, op, nothing, F.col("crs_authid"))))
    return seen.select(*KEYS, order_key().alias("k"), F.explode(F.concat(fields, extra)).alias("c")).select(*KEYS, "k", "c.*")


def rows_of(best: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the latest cells make, without deleted entities; ``best``: ``keys``, kind, field, ``v``."""
    last, kind = F.when(F.col("kind") == 2, F.col("v")), F.col("kind")
    rows = best.groupBy(*keys).agg(
        F.max(last["value"]).alias("last_op"),
        F.max(last["k"]["event_id"]).alias("last_event_id"),
        F.max(last["k"]["created_at"]).alias("last_at"),
        F.max(last["crs"]).alias("crs"),
        F.map_from_entries(F.collect_list(F.when(kind == 0, F.struct("field", "v.value")))).alias("attributes"),
        F.max(F.when(kind == 1, F.col("v.wkb"))).alias("geometry_wkb"),
    )
    return rows.where("last_op <> 'DELETE'").withColumn("attributes", F.when(F.size("attributes") > 0, F.col("attributes")))


def snapshot_counts(events: DataFrame, at: str) -> DataFrame:
    """One row: entities there, absent (deleted) and not yet known at ``at``, and traces resolved and not.

    No payload is read but of the events that traces refer to.
    """
    active = events.where(is_active())
    chains = keyed(active).groupBy(*KEYS).agg(F.max_by("operation_type", F.when(before(at), order_key())).alias("op"))
    traces = trace_origins(active).agg(F.count_if(~F.col("missing")).alias("n_traces_resolved"), F.count_if("missing").alias("n_traces_missing"))
    counts = chains.agg(
        F.count_if(F.col("op") != "DELETE").alias("n_entities"),
        F.count_if(F.col("op") == "DELETE").alias("n_absent"),
        F.count_if(F.col("op").isNull()).alias("n_unknown"),
    )
    return counts.join(F.broadcast(traces))  # one row each


def changed_after(state: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """Rows of a state whose entity has an event after ``at``, by the text of its time."""
    later = keyed(events.where(is_active() & (F.col("created_at") > F.lit(moments.normalised_cutoff(at))))).select(*KEYS).distinct()
    return state.join(later, KEYS, "left_semi")


#: A review reads at most so many events.
REVIEW_BUDGET = 500_000


def review(events: DataFrame, at: str, budget: int = REVIEW_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(events of a review, one row that says how whole it is: n_events, n_read, partial, reason).

    A review reads the active events up to ``at``, the newest first where they are more than ``budget``; then ``partial``
    is set and ``reason`` says so, rather than that some are left out silently.
    """
    seen = visible(events, at)
    total = seen.agg(F.count("*").alias("n_events"))
    n_read = F.least("n_events", F.lit(budget))
    told = total.select("n_events", n_read.alias("n_read"), (F.col("n_events") > budget).alias("partial"))
    reason = F.when(F.col("partial"), F.format_string("only the newest %d of %d events were read", "n_read", "n_events"))
    return seen.orderBy(F.desc("created_at"), F.desc("event_id")).limit(budget), told.withColumn("reason", reason)


def in_view(state: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of a state that touch their source's box: ``boxes(datasource_fingerprint, x0, y0, x1, y1)``, one a source.

    Rows without geometry, and sources without a box, stay.
    """
    met = state.withColumn("_e", geometry.envelope("geometry_wkb")).join(boxes, "datasource_fingerprint", "left")
    apart = (F.col("_e.xmax") < F.col("x0")) | (F.col("_e.xmin") > F.col("x1")) | (F.col("_e.ymax") < F.col("y0")) | (F.col("_e.ymin") > F.col("y1"))
    return met.where(F.coalesce(~apart, F.lit(True))).select(*state.columns)


def date_range(events: DataFrame, today: str) -> DataFrame:
    """One row: the first and last time of active events; 2020-01-01 and the end of ``today`` where there are none."""
    out = events.where(is_active()).agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return out.select(F.coalesce("a", F.lit("2020-01-01T00:00:00")).alias("first_at"), F.coalesce("b", F.lit(f"{today}T23:59:59")).alias("last_at"))


def exported(state: DataFrame, fields: dict[str, str], at: str) -> DataFrame:
    """A typed table of a state: a column for each field of ``fields`` (name -> long, double, string, ...), the geometry,
    and the instant and last operation. Values that can't be read as their type are null."""
    typed = [payload.cell(F.element_at("attributes", F.lit(name)), kind).alias(name) for name, kind in fields.items()]
    return state.select(*KEYS, *typed, "geometry_wkb", F.lit(at).alias("_snap_date"), F.col("last_op").alias("_snap_op"))
