"""Statistics, audit and diagnostics of a journal. Each report is one pass with map-side aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import moments
from stratalog.sources.journal import OPERATIONS, is_active, is_trace

#: Levels of health and the bytes and events from which they hold.
HEALTH = (("critical", 500 << 20, 1_000_000), ("warning", 200 << 20, 500_000), ("info", 50 << 20, 100_000))
#: Upper ends of the chain length histogram.
CHAIN_BINS = ((1, "1"), (5, "2-5"), (10, "6-10"), (50, "11-50"))


def _stat_columns() -> list[Column]:
    return [
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.array_join(F.array_sort(F.collect_set("operation_type")), ",").alias("operations"),
        F.count("*").alias("n_events"),
        F.count_if(~is_trace()).alias("n_user_events"),
    ]


def layer_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("datasource_fingerprint").agg(*_stat_columns())


def global_stats(events: DataFrame) -> DataFrame:
    return events.agg(*_stat_columns())


def all_stats(events: DataFrame) -> DataFrame:
    """Layer statistics and, with a null fingerprint, those of the whole journal, in one pass."""
    return events.rollup("datasource_fingerprint").agg(*_stat_columns())


def audit_counts(events: DataFrame) -> DataFrame:
    """One row of counts; users, layers and dates are over all events, operations over user events."""
    return events.agg(
        F.count("*").alias("n_total"),
        F.count_if(~is_trace()).alias("n_user"),
        F.count_if(is_trace()).alias("n_trace"),
        *[F.count_if((F.col("operation_type") == op) & ~is_trace()).alias(f"n_{op.lower()}") for op in OPERATIONS],
        F.countDistinct("user_name").alias("n_users"),
        F.countDistinct("datasource_fingerprint").alias("n_layers"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def _top(n: int) -> int:
    return max(1, min(n, 100))


def top_users(events: DataFrame, n: int = 10) -> DataFrame:
    counts = events.where(~is_trace()).groupBy("user_name").agg(F.count("*").alias("n_events"))
    return counts.orderBy(F.desc("n_events"), "user_name").limit(_top(n))


def top_layers(events: DataFrame, n: int = 10) -> DataFrame:
    counts = events.where(~is_trace()).groupBy("datasource_fingerprint").agg(F.max("layer_name_snapshot").alias("layer_name"), F.count("*").alias("n_events"))
    return counts.orderBy(F.desc("n_events"), "datasource_fingerprint").limit(_top(n))


def chain_lengths(events: DataFrame) -> DataFrame:
    """Histogram of the user events per entity fingerprint: bin, n_entities."""
    chains = events.where(~is_trace() & F.col("entity_fingerprint").isNotNull()).groupBy("entity_fingerprint").agg(F.count("*").alias("n"))
    name = F.when(F.lit(False), "")
    for most, text in CHAIN_BINS:
        name = name.when(F.col("n") <= most, text)
    return chains.groupBy(name.otherwise("51+").alias("bin")).agg(F.count("*").alias("n_entities"))


def storage_report(events: DataFrame) -> DataFrame:
    """One row: geometries there and missing, moves that moved nothing, and what repeated field schemas cost."""
    both = F.col("geometry_wkb") == F.col("new_geometry_wkb")
    characters = F.length("field_schema_json")
    own = events.where(~is_trace())
    out = own.agg(
        F.count("geometry_wkb").alias("n_geometry"),
        F.count_if(F.col("geometry_wkb").isNull()).alias("n_no_geometry"),
        F.count("new_geometry_wkb").alias("n_new_geometry"),
        F.count_if(F.col("new_geometry_wkb").isNull()).alias("n_no_new_geometry"),
        F.count_if(both).alias("n_unmoved"),
        F.coalesce(F.sum(F.when(both, F.octet_length("geometry_wkb"))), F.lit(0)).alias("unmoved_bytes"),
        F.coalesce(F.sum(characters), F.lit(0)).alias("schema_characters"),
        F.countDistinct("field_schema_json").alias("n_schemas"),
        F.coalesce(F.avg(characters), F.lit(0.0)).alias("mean_schema"),
    )
    saved = F.greatest(F.lit(0), F.col("schema_characters") - F.floor(F.col("mean_schema") * F.col("n_schemas")))
    return out.withColumn("schema_saving", saved.cast("long")).drop("mean_schema")


def born_and_gone(events: DataFrame) -> DataFrame:
    """(entity, session) pairs whose user events both create and delete; a null session is one session."""
    own = events.where(~is_trace() & F.col("entity_fingerprint").isNotNull())
    of = lambda op: own.where(F.col("operation_type") == op).select("entity_fingerprint", "session_id")
    return of("INSERT").intersect(of("DELETE"))


def oldest_event(events: DataFrame, wanted: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """``first_at`` of all events, or of the sources ``wanted(fingerprint)`` under any of their names."""
    from stratalog.operators.scope import in_scope

    own = events if wanted is None else in_scope(events, wanted, aliases)
    return own.agg(F.min("created_at").alias("first_at"))


def _level(value: Column, place: int) -> Column:
    out = F.when(F.lit(False), 0)
    for rank, level in enumerate(HEALTH):
        out = out.when(value >= level[place], 3 - rank)
    return out.otherwise(0)


def health(events: DataFrame, size_bytes: int) -> DataFrame:
    """One row: the worse of the levels by size and by count, with the span covered."""
    out = events.agg(F.count("*").alias("n_events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    rank = F.greatest(_level(F.lit(size_bytes), 1), _level(F.col("n_events"), 2))
    name = F.element_at(F.array(F.lit("healthy"), *[F.lit(x[0]) for x in reversed(HEALTH)]), rank + 1)
    return out.select("n_events", "first_at", "last_at", name.alias("level"), moments.coverage_months("first_at", "last_at").alias("coverage_months"))


def activity_segments(events: DataFrame, least_gap: int = 3600, share: float = 0.03) -> DataFrame:
    """Spans of activity of each source, parted where nothing happens for longer than ``least_gap`` seconds and than
    ``share`` of the source's whole span: datasource_fingerprint, start, end, n_events.

    Events are first reduced to their distinct instants, so the ordered pass is over seconds, not events.
    """
    instants = (
        events.select("datasource_fingerprint", moments.instant("created_at").alias("at")).where("at IS NOT NULL").groupBy("datasource_fingerprint", "at").agg(F.count("*").alias("n"))
    )
    source = Window.partitionBy("datasource_fingerprint")
    line = source.orderBy("at")
    span = moments.seconds_between(F.max("at").over(source), F.min("at").over(source))
    gap = moments.seconds_between(F.col("at"), F.lag("at").over(line))
    marked = instants.withColumn("apart", (gap > F.greatest(F.lit(float(least_gap)), span * F.lit(share))).cast("int"))
    numbered = marked.withColumn("segment", F.sum(F.coalesce("apart", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("datasource_fingerprint", "segment").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.sum("n").alias("n_events")).drop("segment")


def daily_activity(events: DataFrame) -> DataFrame:
    """Events of each calendar day and operation, with the days between that have none."""
    days = events.select(F.to_date(moments.instant("created_at")).alias("day"), "operation_type").where("day IS NOT NULL")
    counts = days.groupBy("day").agg(*[F.count_if(F.col("operation_type") == op).alias(f"n_{op.lower()}") for op in OPERATIONS])
    bounds = counts.agg(F.min("day").cast("timestamp").alias("start"), F.max("day").cast("timestamp").alias("end"))
    every = moments.ticks(bounds, "day").select(F.to_date("tick").alias("day"))
    names = [f"n_{op.lower()}" for op in OPERATIONS]
    return every.join(counts, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def mass_deletes(events: DataFrame, least: int = 100) -> DataFrame:
    """Commits (one source, one created_at) that delete ``least`` entities or more."""
    gone = events.where((F.col("operation_type") == "DELETE") & ~is_trace())
    return gone.groupBy("datasource_fingerprint", "created_at").agg(F.count("*").alias("n_deleted")).where(F.col("n_deleted") >= least)


def anomalies(cycles: DataFrame) -> DataFrame:
    """``cycles`` (cycle, plan_actions, apply_ok, apply_skipped, apply_fail, user, traces, traces_invalidated,
    dedup_active, dedup_dropped, traces_written) with ``anomalies``: the codes of what looks wrong."""
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in cycles.columns if k != "cycle"}
    rewind, undo = F.col("cycle") == "rewind", F.col("cycle").isin("undo", "auto_undo")
    active = F.greatest(c["traces"] - c["traces_invalidated"], F.lit(0))
    emptied = rewind & (c["user"] > 0) & (c["dedup_active"] == 0)
    rules = [
        (rewind & (c["plan_actions"] > 0) & (c["apply_ok"] == 0) & (c["apply_skipped"] == c["plan_actions"]), "all_skipped"),
        (emptied & (active > 0), "already_at_target"),
        (emptied & (active == 0), "all_collapsed_no_traces"),
        (rewind & (active >= 5) & (c["dedup_dropped"] < F.floor(active / 2)), "low_neutralization"),
        (rewind & (c["apply_ok"] > 0) & (c["traces_written"] == 0), "missing_traces"),
        (c["apply_fail"] > 0, "apply_failures"),
        (undo & (c["apply_ok"] > 0) & (c["apply_fail"] > 0), "undo_partial"),
    ]
    return cycles.withColumn("anomalies", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in rules])), ","))


def active_traces(events: DataFrame) -> DataFrame:
    return events.where(is_trace() & is_active())


def has_active_traces(events: DataFrame, wanted: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """One row, ``has_traces``: whether any active trace is there, in the sources ``wanted(fingerprint)`` under any name."""
    from stratalog.operators.scope import in_scope

    own = active_traces(events) if wanted is None else in_scope(active_traces(events), wanted, aliases)
    return own.limit(1).agg((F.count("*") > 0).alias("has_traces"))


def diagnostics(events: DataFrame) -> DataFrame:
    """One row: everything that a diagnosis of a journal counts; bins of entities by chain length as a map."""
    from stratalog.operators.retention import pairs

    own = events.where(~is_trace())
    bins = chain_lengths(events).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "n_entities")))).alias("bins"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("total_entities"))
    counts = own.agg(F.count("*").alias("total_events"))
    gone = events.agg(F.count("invalidated_at").alias("n_invalidated"))
    out = storage_report(events)
    for one in (counts, bins, gone, pairs(events).agg(F.count("*").alias("n_pairs"))):
        out = out.join(F.broadcast(one))  # one row each
    return out


def diagnostic_text(found: DataFrame) -> DataFrame:
    """``diagnostics`` as lines of text: place, line."""
    size = lambda c: moments.size_text(c, "report")
    n = lambda c: F.col(c).cast("string")
    share = lambda v: F.format_string("%.1f", 100.0 * v / F.greatest(F.col("total_entities"), F.lit(1)))
    lines = [F.concat(F.lit("events: "), n("total_events")), F.concat(F.lit("entities: "), n("total_entities"))]
    for _, name in (*CHAIN_BINS, (0, "51+")):
        value = F.coalesce(F.element_at("bins", F.lit(name)), F.lit(0))
        lines.append(F.concat(F.lit(f"entities with {name} events: "), value.cast("string"), F.lit(" ("), share(value), F.lit("%)")))
    named = {"geometries": "n_geometry", "without geometry": "n_no_geometry", "new geometries": "n_new_geometry", "without new geometry": "n_no_new_geometry", "unmoved": "n_unmoved"}
    lines += [F.concat(F.lit(f"{k}: "), n(v)) for k, v in named.items()]
    lines += [F.concat(F.lit("unmoved bytes: "), size("unmoved_bytes")), F.concat(F.lit("field schemas: "), size("schema_characters"), F.lit(", "), n("n_schemas"), F.lit(" distinct"))]
    lines += [F.concat(F.lit("saved by one copy of each schema: "), size("schema_saving"))]
    lines += [F.concat(F.lit("invalidated traces: "), n("n_invalidated")), F.concat(F.lit("insert and delete pairs: "), n("n_pairs"))]
    return found.select(F.posexplode(F.array(*lines)).alias("place", "line"))


#: What each issue of ``integrity.issues`` means to a reader.
ISSUE_TEXTS = {
    "orphan_trace": "Some restores point at events that are gone.",
    "session_without_events": "Some sessions have no events.",
    "source_without_events": "Some registered sources have no events.",
    "newer_layout": "Some events were written by a later version and may not be read in full.",
    "invalid_event": "Some events can't be read; the last edits may be incomplete.",
    "repeated_id": "Some events share a number.",
}


def issue_text(issue: Column | str) -> Column:
    """A sentence for an issue; one that isn't known is named."""
    c = F.col(issue) if isinstance(issue, str) else issue
    out = F.when(F.lit(False), F.lit(""))
    for name, text in ISSUE_TEXTS.items():
        out = out.when(c == name, text)
    return out.otherwise(F.concat(F.lit("Something is wrong: "), c))


#: Bytes left on a volume below which it is low, and critical.
LOW_BYTES, CRITICAL_BYTES = 500 << 20, 100 << 20


def volume_level(free_bytes: Column | str) -> Column:
    """``ok``, ``low`` or ``critical``; a volume that can't be measured is critical."""
    c = F.col(free_bytes) if isinstance(free_bytes, str) else free_bytes
    return F.when(c.isNull() | (c < CRITICAL_BYTES), "critical").when(c < LOW_BYTES, "low").otherwise("ok")
