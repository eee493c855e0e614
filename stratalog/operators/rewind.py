"""What must be compensated to take data back to a cutoff, reduced to the least set of events.

Events after the cutoff are split where an id was used again for another entity, freed of what earlier rewinds have
compensated already, and collapsed along each entity's chain. All of it is ordered scans in two levels (``scans``) and
combining aggregates over (source, entity); no chain is gathered in memory or sorted in one task, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import identity, moments, payload
from stratalog.operators import scans
from stratalog.session import settled
from stratalog.sources.journal import is_active, is_trace, order_key

KEYS = ["datasource_fingerprint", "entity"]
#: Chains with more events than this are fused.
LONGEST_CHAIN = 10


@dataclass(frozen=True)
class Cutoff:
    """A point to go back to: a date (``by="created_at"``) or an event (``by="event_id"``)."""

    value: object
    by: str = "created_at"
    inclusive: bool = True

    def after(self, prefix: str = "") -> Column:
        """Whether an event lies on the far side; an unreadable date selects nothing."""
        if self.by not in ("created_at", "event_id"):
            raise ValueError(f"a cutoff is by created_at or event_id, not {self.by}")
        value = moments.normalised_cutoff(self.value) if self.by == "created_at" else self.value
        column, bound = F.col(f"{prefix}{self.by}"), F.lit(value).cast("string" if self.by == "created_at" else "long")
        return F.coalesce(column >= bound if self.inclusive else column > bound, F.lit(False))


def _told(events: DataFrame, scoped: DataFrame, cutoff: Cutoff) -> DataFrame:
    """Active traces with ``source_in`` (the source is in the scope and after the cutoff), ``source_there`` (anywhere)."""
    traces = scoped.where(is_trace() & is_active())
    refs = traces.select(F.col("restored_from_event_id").alias("event_id")).distinct()
    there = events.join(refs, "event_id", "left_semi").select(F.col("event_id").alias("restored_from_event_id"))
    inside = scoped.where(cutoff.after()).join(refs, "event_id", "left_semi").select(F.col("event_id").alias("restored_from_event_id"))
    there = there.distinct().withColumn("source_there", F.lit(True))
    inside = inside.distinct().withColumn("source_in", F.lit(True))
    out = traces.join(there, "restored_from_event_id", "left").join(inside, "restored_from_event_id", "left")
    return out.select(*events.columns, F.coalesce("source_in", F.lit(False)).alias("source_in"), F.coalesce("source_there", F.lit(False)).alias("source_there"))


def window_events(events: DataFrame, cutoff: Cutoff, scoped: DataFrame | None = None) -> DataFrame:
    """User events after the cutoff, active traces of events after it, and active traces after it whose source is gone.

    ``scoped`` are the events of the sources to rewind (default: all); whether a source is gone is asked of all events.
    """
    scoped = events if scoped is None else scoped
    users = scoped.where(~is_trace() & cutoff.after())
    traces = _told(events, scoped, cutoff).where(F.col("source_in") | (cutoff.after() & ~F.col("source_there")))
    return users.unionByName(traces.select(*events.columns))


def forward_traces(events: DataFrame, cutoff: Cutoff, scoped: DataFrame | None = None) -> DataFrame:
    """Active traces whose source lies before the cutoff: the compensations to undo to go forward to it."""
    scoped = events if scoped is None else scoped
    before = scoped.where(~cutoff.after()).select(F.col("event_id").alias("restored_from_event_id"))
    return scoped.where(is_trace() & is_active()).join(before.distinct(), "restored_from_event_id", "left_semi").select(*events.columns)


def newest_first(window: DataFrame, limit: int | None = 10_000) -> DataFrame:
    out = window.orderBy(F.desc("created_at"), F.desc("event_id"))
    return out if limit is None else out.limit(limit)


#: A rewind reads at most so many events of a source.
MOST_FETCHED = 10_000


def newest_of_each(window: DataFrame, limit: int = MOST_FETCHED, salts: int = 64) -> DataFrame:
    """The newest ``limit`` events of each source, newest first over all; each source is dealt over ``salts`` tasks first."""
    line = lambda *more: Window.partitionBy("datasource_fingerprint", *more).orderBy(F.desc("created_at"), F.desc("event_id"))
    salted = window.withColumn("_salt", F.pmod(F.xxhash64("event_id", "created_at"), F.lit(salts)))
    some = salted.withColumn("_place", F.row_number().over(line("_salt"))).where(F.col("_place") <= limit)
    some = some.withColumn("_place", F.row_number().over(line())).where(F.col("_place") <= limit)
    return some.drop("_salt", "_place").orderBy(F.desc("created_at"), F.desc("event_id"))


def truncated_sources(window: DataFrame, limit: int = MOST_FETCHED) -> DataFrame:
    """(datasource_fingerprint, n_events, n_dropped): sources of which a fetch of ``limit`` events would leave out the oldest.

    These hold the state at the cutoff, so a rewind of such a source from a cut window is refused, never run in part.
    """
    counts = window.groupBy("datasource_fingerprint").agg(F.count("*").alias("n_events"))
    return counts.where(F.col("n_events") > limit).withColumn("n_dropped", F.col("n_events") - limit)


class TruncatedWindow(ValueError):
    """A window has more events than may be read."""


def whole_window(window: DataFrame, limit: int | None = MOST_FETCHED) -> DataFrame:
    """The window, or an error where a source has more than ``limit`` events; None lifts the limit."""
    if limit is not None:
        cut = truncated_sources(window, limit).orderBy(F.desc("n_events")).limit(3).collect()
        if cut:
            told = ", ".join(f"{r['datasource_fingerprint']} has {r['n_events']}" for r in cut)
            raise TruncatedWindow(f"more than {limit} events: {told}; choose a later cutoff or lift the limit")
    return window


def reused_ids(window: DataFrame, parts: int | None = None) -> DataFrame:
    """(datasource_fingerprint, entity_fingerprint, split_at, split_id): the last place where an id began another life.

    That is an insert after a delete or after updates of an entity that was there before, or an update after a delete.
    Only user events that no active trace compensates count. ``parts``: as in ``scans.bucketed``, here and below.
    """
    done = window.where(is_trace() & is_active()).select(F.col("restored_from_event_id").alias("event_id")).distinct()
    live = window.where(~is_trace() & F.col("entity_fingerprint").isNotNull()).join(done, "event_id", "left_anti")
    op, keys, order = F.col("operation_type"), ["datasource_fingerprint", "entity_fingerprint"], ["created_at", "event_id"]
    turning = F.when(op != "UPDATE", op)
    live = scans.bucketed(live.select(*keys, *order, "operation_type"), keys, order, parts)
    live = scans.carried(
        live,
        keys,
        lambda rows: rows.groupBy(scans.BUCKET, *keys).agg(F.max_by(op, order_key()).alias("op"), F.max_by(turning, F.when(turning.isNotNull(), order_key())).alias("turn")),
        {"_op": F.last("op").over(scans.earlier(keys)), "_turn": F.last("turn", ignorenulls=True).over(scans.earlier(keys))},
    )
    line = scans.line(keys, order)
    before = F.coalesce(F.lag(op).over(line), F.col("_op"))
    turn = F.coalesce(F.last(turning, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("_turn"))
    state = F.when(before.isNull(), "none").when(before == "DELETE", "closed").when(turn == "INSERT", "open").otherwise("before")
    marked = live.select("datasource_fingerprint", "entity_fingerprint", order_key().alias("k"), "operation_type", state.alias("state"))
    splits = marked.where("operation_type = 'INSERT' AND state IN ('closed', 'before') OR operation_type = 'UPDATE' AND state = 'closed'")
    return splits.groupBy("datasource_fingerprint", "entity_fingerprint").agg(F.max("k").alias("k")).select(
        "datasource_fingerprint", "entity_fingerprint", F.col("k.created_at").alias("split_at"), F.col("k.event_id").alias("split_id")
    )


def split_lives(window: DataFrame) -> DataFrame:
    """The window with ``entity``: the entity's key, ``@`` and the splitting event for what lies at a split or after."""
    met = window.join(reused_ids(window), ["datasource_fingerprint", "entity_fingerprint"], "left")
    behind = order_key() >= F.struct(F.col("split_at").alias("created_at"), F.col("split_id").alias("event_id"))
    name = F.when(behind, F.concat("entity_fingerprint", F.lit("@"), F.col("split_id").cast("string"))).otherwise(F.col("entity_fingerprint"))
    return met.withColumn("entity", identity.entity_key(name)).select(*window.columns, "entity")


def compensated_spans(lives: DataFrame) -> DataFrame:
    """(datasource_fingerprint, entity, event_id, ref, lo, hi): what each active trace of the window has compensated.

    From its source to the trace itself if the source is a user event; nothing by range if the source is a trace; from
    the window's start if the source is not in the window at all.
    """
    traces = lives.where(is_trace() & is_active()).select(*KEYS, "event_id", F.col("restored_from_event_id").alias("ref"), order_key().alias("hi"))
    sources = lives.select(F.col("event_id").alias("ref"), is_trace().alias("by_trace"), order_key().alias("source"))
    floor = F.broadcast(lives.agg(F.min(order_key()).alias("floor")))  # one row
    met = traces.join(sources, "ref", "left").join(floor)
    lo = F.when(F.col("by_trace").isNull(), F.col("floor")).when(F.col("by_trace"), F.col("hi")).otherwise(F.col("source"))
    return met.select(*KEYS, "event_id", "ref", lo.alias("lo"), "hi")


def neutralised(lives: DataFrame, parts: int | None = None) -> DataFrame:
    """User events of the window with ``dropped``: compensated by an active trace, by name or within its span.

    Spans and events meet in one ordered pass: an event is inside if more spans have begun than ended at its place.
    """
    spans = compensated_spans(lives)
    refs = spans.select(F.col("ref").alias("event_id")).distinct().withColumn("named", F.lit(True))
    users = lives.where(~is_trace()).join(refs, "event_id", "left")
    ends = spans.where("lo < hi")
    ends = ends.select(*KEYS, F.col("lo").alias("k"), F.lit(1).alias("step")).union(ends.select(*KEYS, F.col("hi").alias("k"), F.lit(-1).alias("step")))
    rows = users.withColumn("k", order_key()).withColumn("step", F.lit(0))
    places = rows.select(*KEYS, "k", "event_id", "step").unionByName(ends, allowMissingColumns=True)
    places = scans.bucketed(places, KEYS, ["k"], parts)
    total = lambda x: x.groupBy(scans.BUCKET, *KEYS).agg(F.sum("step").alias("steps"))
    places = scans.carried(places, KEYS, total, {"_begun": F.sum("steps").over(scans.earlier(KEYS))})
    line = scans.line(KEYS, ["k"]).rangeBetween(Window.unboundedPreceding, 0)
    inside = F.sum("step").over(line) + F.coalesce("_begun", F.lit(0)) > 0
    within = places.withColumn("inside", inside).where("step = 0 AND inside").select("event_id", "inside").distinct()
    out = rows.join(within, "event_id", "left")
    return out.select(*lives.columns, (F.coalesce("named", F.lit(False)) | F.coalesce("inside", F.lit(False))).alias("dropped"))


def survivors(active: DataFrame, parts: int | None = None) -> DataFrame:
    """User events without the lives that begin and end among them.

    A delete ends the life that began last and is still open. With a running sum of begun less ended lives, kept from
    falling below zero, an event belongs to a life that ends if the sum falls below the event's own level later on.
    """
    order = ["created_at", "event_id"]
    step = F.when(F.col("operation_type") == "INSERT", 1).when(F.col("operation_type") == "DELETE", -1).otherwise(0)
    rows = scans.bucketed(active.select(*KEYS, *order, "operation_type", step.alias("_step")), KEYS, order, parts)
    line = scans.line(KEYS, order)
    upto, later = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(1, Window.unboundedFollowing)

    def sums(some: DataFrame) -> DataFrame:
        some = some.withColumn("s", F.sum("_step").over(upto))
        return some.groupBy(scans.BUCKET, *KEYS).agg(F.sum("_step").alias("s"), F.min("s").alias("least"))

    # A bucket that begins at level x ends at max(x + s, s - least), and its least level is max(x + least, 0).
    before, after = scans.earlier(KEYS), scans.later(KEYS)
    rows = scans.carried(
        rows,
        KEYS,
        sums,
        {"_s": F.coalesce(F.sum("s").over(before), F.lit(0))},
        {"_floor": F.least(F.lit(0), F.min(F.col("_s") + F.col("least")).over(before))},
        {"_start": F.col("_s") - F.col("_floor")},
        {"_least": F.greatest(F.col("_start") + F.col("least"), F.lit(0))},
        {"_start": F.col("_start"), "_then": F.min("_least").over(after)},
    )
    start = F.coalesce("_start", F.lit(0))
    out = rows.withColumn("_sum", F.sum("_step").over(upto))
    out = out.withColumn("_floor", F.least(F.lit(0), F.min("_sum").over(upto)))
    out = out.withColumn("_level", F.greatest(start + F.col("_sum"), F.col("_sum") - F.col("_floor")))
    out = out.withColumn("_before", F.coalesce(F.lag("_level").over(line), start))
    ended = (F.col("_level") > 0) & (F.coalesce(F.least(F.min("_level").over(later), F.col("_then")), F.col("_level")) < F.col("_level"))
    gone = F.when(F.col("operation_type") == "DELETE", F.col("_before") > 0).otherwise(ended)
    return active.join(out.withColumn("_gone", gone).where("_gone").select("event_id"), "event_id", "left_anti")


def collapse(active: DataFrame) -> DataFrame:
    """The events that are left to compensate, with ``fused``: how many events a fused one stands for (1: itself).

    Updates before a delete become one delete with the whole state as of the cutoff. A chain of more than ten updates
    becomes one update from the oldest values to the newest; another long chain keeps its ends. Others stay as they are.
    """
    kept = settled(survivors(active))
    op, k = F.col("operation_type"), order_key()
    whole = kept.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.min(k).alias("first_k"),
        F.max(k).alias("last_k"),
        F.min_by("operation_type", k).alias("first_op"),
        F.max_by("operation_type", k).alias("last_op"),
        F.count_if(op != "UPDATE").alias("others"),
    )
    to_delete = (F.col("n") > 1) & (F.col("first_op") == "UPDATE") & (F.col("last_op") == "DELETE") & (F.col("others") == 1)
    long = F.col("n") > LONGEST_CHAIN
    to_update = long & (F.col("first_op") == "UPDATE") & (F.col("last_op") == "UPDATE")
    kind = F.when(to_delete, "delete").when(to_update, "update").when(long, "ends").otherwise("all")
    whole = settled(whole.select(*KEYS, "n", "first_k", "last_k", kind.alias("kind")))  # no payloads; read twice
    met = kept.withColumn("_k", k)
    plain = met.join(whole.where("kind IN ('all', 'ends')"), KEYS).where("kind = 'all' OR _k = first_k OR _k = last_k")
    plain = plain.select(*active.columns, F.lit(1).cast("long").alias("fused"))
    fused = met.join(whole.where("kind IN ('delete', 'update')"), KEYS)
    outer = fused.groupBy(*KEYS).agg(
        F.max_by(F.struct("feature_identity_json", "entity_fingerprint", "new_geometry_wkb", "geometry_wkb", "attributes_json"), "_k").alias("newest"),
        F.min_by("geometry_wkb", F.when((op == "UPDATE") & F.col("geometry_wkb").isNotNull(), F.col("_k"))).alias("oldest_shape"),
    )
    cells = fused.where(op == "UPDATE").select(*KEYS, "_k", F.explode(payload.changes()).alias("field", "v"))
    cells = cells.groupBy(*KEYS, "field").agg(F.min_by(F.struct("v.old"), "_k").alias("o"), F.max_by(F.struct("v.new"), "_k").alias("w"))
    merged = cells.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("o.old", "w.new")))).alias("merged"))
    fused = fused.where("_k = first_k").join(outer, KEYS).join(merged, KEYS, "left")
    none = F.create_map().cast("map<string,struct<old:string,new:string>>")
    change = F.coalesce("merged", none)
    old = F.transform_values(change, lambda _, v: v["old"])
    newest = payload.old_attributes("newest.attributes_json")
    start = F.when(F.size(newest) > 0, newest).otherwise(payload.old_attributes())
    state = F.map_concat(F.map_filter(start, lambda f, _: ~F.map_contains_key(old, f)), old)
    deletes, is_delete = payload.to_full_payload(state), F.col("kind") == "delete"
    changed = {
        "operation_type": F.when(is_delete, "DELETE").otherwise("UPDATE"),
        "attributes_json": F.when(is_delete, deletes).when(F.size(change) > 0, payload.to_payload(change)).otherwise(F.col("attributes_json")),
        "geometry_wkb": F.when(is_delete, F.coalesce("oldest_shape", "newest.geometry_wkb")).otherwise(F.coalesce("oldest_shape", "geometry_wkb")),
        "new_geometry_wkb": F.when(is_delete, F.col("new_geometry_wkb")).otherwise(F.col("newest.new_geometry_wkb")),
        "feature_identity_json": F.col("newest.feature_identity_json"),
        "entity_fingerprint": F.col("newest.entity_fingerprint"),
    }
    fused = fused.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in active.columns], F.col("n").alias("fused"))
    return plain.unionByName(fused)


def judged_events(window: DataFrame) -> DataFrame:
    """``neutralised`` of a window, with its lives apart; the steps between are computed once."""
    return settled(neutralised(settled(split_lives(settled(window)))))


def rewind_events(window: DataFrame) -> DataFrame:
    """The least events to compensate of a window: its columns, ``entity`` and ``fused``."""
    return collapse(judged_events(window).where("NOT dropped").drop("dropped"))


def rewind_stats(window: DataFrame) -> DataFrame:
    """One row of counters: raw, user, traces, traces_invalidated, traces_active, dedup_dropped, dedup_active, dedup_redundant."""
    window = settled(window)
    counts = window.agg(
        F.count("*").alias("raw"),
        F.count_if(~is_trace()).alias("user"),
        F.count_if(is_trace()).alias("traces"),
        F.count_if(is_trace() & ~is_active()).alias("traces_invalidated"),
        F.count_if(is_trace() & is_active()).alias("traces_active"),
    )
    rows = judged_events(window)
    judged = rows.agg(F.count_if("dropped").alias("dedup_dropped"), F.count_if(~F.col("dropped")).alias("left"))
    least = collapse(rows.where("NOT dropped").drop("dropped")).agg(F.count("*").alias("dedup_active"))
    both = counts.join(F.broadcast(judged)).join(F.broadcast(least))  # one row each
    return both.withColumn("dedup_redundant", F.col("left") - F.col("dedup_active")).drop("left")
