"""Searching and summarising events."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import geometry
from stratalog.sources.journal import OPERATIONS, is_trace, order_key

PAGE_SIZE, MOST_PAGE_SIZE = 100, 500
MOST_DISTINCT = 1000
MOST_CHARACTERS = 1000


@dataclass(frozen=True)
class Criteria:
    """What to search; None means any. Bounds compare with ``created_at`` as text, both ends included."""

    fingerprints: tuple[str, ...] | None = None
    layer_name: str | None = None
    operation: str | None = None
    user_name: str | None = None
    start: str | None = None
    end: str | None = None
    traces: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if any(isinstance(v, str) and len(v) > MOST_CHARACTERS for v in (value if isinstance(value, tuple) else (value,))):
                raise ValueError(f"{f.name} has more than {MOST_CHARACTERS} characters")


def matching(events: DataFrame, c: Criteria) -> DataFrame:
    """Events that meet the criteria; every condition can be pushed to the scan."""
    tests: list[Column] = [] if c.traces else [~is_trace()]
    if c.fingerprints is not None:
        tests.append(F.col("datasource_fingerprint").isin(*c.fingerprints))
    pairs = (("layer_name_snapshot", c.layer_name), ("operation_type", c.operation), ("user_name", c.user_name))
    tests += [F.col(name) == value for name, value in pairs if value is not None]
    if c.start is not None:
        tests.append(F.col("created_at") >= c.start)
    if c.end is not None:
        tests.append(F.col("created_at") <= c.end)
    for test in tests:
        events = events.where(test)
    return events


def search_page(events: DataFrame, c: Criteria, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of the matches, newest first; ties in time go by id."""
    size = max(1, min(size, MOST_PAGE_SIZE))
    found = matching(events, c).orderBy(F.desc("created_at"), F.desc("event_id"))
    return found.offset((max(1, page) - 1) * size).limit(size)


def count_matching(events: DataFrame, c: Criteria) -> DataFrame:
    return matching(events, c).agg(F.count("*").alias("n_events"))


def summary(events: DataFrame, c: Criteria) -> DataFrame:
    """One row: totals of the scope whatever the operation, and ``selected_count`` of the operation asked for."""
    wide = Criteria(**{f.name: getattr(c, f.name) for f in fields(c) if f.name != "operation"})
    chosen = F.lit(True) if c.operation is None else F.col("operation_type") == c.operation
    return matching(events, wide).agg(
        F.count("*").alias("total_count"),
        F.count_if(chosen).alias("selected_count"),
        F.countDistinct("user_name").alias("n_users"),
        F.countDistinct("datasource_fingerprint").alias("n_sources"),
        *[F.count_if(F.col("operation_type") == op).alias(f"n_{op.lower()}") for op in OPERATIONS],
    )


def distinct_users(events: DataFrame) -> DataFrame:
    return events.select("user_name").distinct().orderBy("user_name").limit(MOST_DISTINCT)


def distinct_layers(events: DataFrame, registry: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """datasource_fingerprint, layer_name: registered names first, else the latest in the journal.

    With ``targets(alias, target)``, a source is left out if its final name is listed too.
    """
    used = events.groupBy("datasource_fingerprint").agg(F.max_by("layer_name_snapshot", order_key()).alias("used_name"))
    told = registry.select("datasource_fingerprint", "layer_name")
    listed = used.join(told, "datasource_fingerprint", "full_outer").select("datasource_fingerprint", F.coalesce("layer_name", "used_name").alias("layer_name"))
    if targets is not None:
        there = listed.select(F.col("datasource_fingerprint").alias("target"))
        hidden = targets.join(there, "target", "left_semi").select(F.col("alias").alias("datasource_fingerprint"))
        listed = listed.join(hidden, "datasource_fingerprint", "left_anti")
    return listed.orderBy("layer_name", "datasource_fingerprint").limit(MOST_DISTINCT)


def entity_stream(events: DataFrame, fingerprint: str, entity: str, limit: int = 10_000) -> DataFrame:
    mine = events.where((F.col("datasource_fingerprint") == fingerprint) & (F.col("entity_fingerprint") == entity))
    return mine.orderBy("event_id").limit(limit)


def session_events(events: DataFrame, session: str, limit: int = 10_000) -> DataFrame:
    return events.where((F.col("session_id") == session) & ~is_trace()).orderBy(F.desc("event_id")).limit(limit)


def session_summary(events: DataFrame) -> DataFrame:
    """One row per session: operation counts, layers and first and last time of its user events."""
    own = events.where(~is_trace() & F.col("session_id").isNotNull())
    return own.groupBy("session_id").agg(
        *[F.count_if(F.col("operation_type") == op).alias(f"n_{op.lower()}") for op in OPERATIONS],
        F.countDistinct("layer_name_snapshot").alias("n_layers"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def zone_events(events: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, limit: int = 5000) -> DataFrame:
    """The earliest ``limit`` events of a time window, then those of them that touch a box or have no geometry."""
    window = events.where((F.col("created_at") >= start) & (F.col("created_at") <= end)).orderBy("created_at", "event_id").limit(limit)
    box = geometry.envelope(F.coalesce("geometry_wkb", "new_geometry_wkb"))
    return window.where(geometry.intersects(box, bbox))


def earliest(events: DataFrame, keys: list[str], limit: int, salts: int = 64) -> DataFrame:
    """The earliest ``limit`` events of each key, by (created_at, event_id).

    Each key is dealt over ``salts`` tasks, each keeps its own earliest, and what is left of a key meets in one task: at
    most ``salts`` times ``limit`` rows, however many events the key has.
    """
    line = lambda *more: Window.partitionBy(*keys, *more).orderBy("created_at", "event_id")
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("event_id", "created_at"), F.lit(salts)))
    some = salted.withColumn("_place", F.row_number().over(line("_salt"))).where(F.col("_place") <= limit)
    return some.withColumn("_place", F.row_number().over(line())).where(F.col("_place") <= limit).drop("_salt", "_place")


def zone_markers(events: DataFrame, bbox: tuple[float, float, float, float], limit: int = 5000) -> DataFrame:
    """Distinct (created_at, operation_type) of the earliest ``limit`` events of each source that touch a box."""
    columns = ["datasource_fingerprint", "created_at", "event_id", "operation_type", "geometry_wkb", "new_geometry_wkb"]
    first = earliest(events.select(*columns), ["datasource_fingerprint"], limit)
    box = geometry.envelope(F.coalesce("geometry_wkb", "new_geometry_wkb"))
    return first.where(geometry.intersects(box, bbox)).select("created_at", "operation_type").distinct().orderBy("created_at", "operation_type")


def whole_within(rows: DataFrame, limit: int) -> DataFrame:
    """One row that says what a limit leaves out: n_rows, limit, truncated. What is cut must be told, or refused."""
    return rows.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(limit).alias("limit"), (F.col("n_rows") > limit).alias("truncated"))


def used_fingerprints(events: DataFrame, limit: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` fingerprints that the journal names, ``whole_within`` of all of them)."""
    every = events.select("datasource_fingerprint").distinct()
    return every.orderBy("datasource_fingerprint").limit(limit), whole_within(every, limit)


def distinct_of(events: DataFrame, column: str, fingerprint: str | None = None) -> DataFrame:
    """The values of one of the layer columns, of one source or of all."""
    if column not in ("layer_id_snapshot", "layer_name_snapshot", "provider_type"):
        raise ValueError(f"{column} is no layer column")
    own = events if fingerprint is None else events.where(F.col("datasource_fingerprint") == fingerprint)
    return own.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def text_matches(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows with the text in any of their cells, whatever its case."""
    line = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in rows.columns]))
    return rows.where(line.contains(wanted.lower()))


def changed_cells(events: DataFrame, most: int = 10) -> DataFrame:
    """A row for each of the first ``most`` changed fields of an update: event_id, field, old, new."""
    from stratalog.functions import payload

    delta = F.map_filter(payload.changes(), lambda k, _: ~payload.is_audit_field(k))
    entries = F.slice(F.array_sort(F.map_entries(delta)), 1, most)
    cells = events.where("operation_type = 'UPDATE'").select("event_id", F.explode(entries).alias("e"))
    return cells.select("event_id", F.col("e.key").alias("field"), F.col("e.value.old").alias("old"), F.col("e.value.new").alias("new"))


def result_grid(events: DataFrame, wanted: list[str]) -> DataFrame:
    """Events with a column for each wanted field, from the state before the event."""
    from stratalog.functions import payload

    state = events.withColumn("_state", payload.old_attributes())
    return state.select("event_id", "operation_type", "created_at", *[F.element_at("_state", F.lit(f)).alias(f) for f in wanted])


def grid_fields(events: DataFrame) -> DataFrame:
    """The fields that a grid of these events would have, each with the first event that brings it."""
    from stratalog.functions import payload

    rows = events.select("event_id", F.explode(F.map_keys(payload.old_attributes())).alias("field"))
    return rows.groupBy("field").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n_events"))


#: Columns that a grid has at most, if not told otherwise.
MOST_FIELDS = 200


def discovered_grid(events: DataFrame, most: int = MOST_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Events with a column for each field that they have, and one row that tells how many fields there are and were left out.

    Fields come in the order of the first event that brings them, then by name; the first ``most`` get a column, with the
    state before the event. ``changed`` are the names of the fields that an update changed, ``geometry_changed`` says whether
    it moved the entity. Fields that are called like a column of the grid are set apart by an underscore.
    """
    from stratalog.functions import payload

    fields = grid_fields(events)
    told = whole_within(fields, most)
    names = [r["field"] for r in fields.orderBy("first_event", "field").limit(most).collect()]  # the columns
    state = events.withColumn("_state", payload.old_attributes())
    fixed = ["event_id", "operation_type", "created_at", "changed", "geometry_changed"]
    taken, columns = {x.lower() for x in fixed}, []
    for f in names:
        name = f
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        columns.append(F.element_at("_state", F.lit(f)).alias(name))
    update = F.col("operation_type") == "UPDATE"
    delta = F.map_filter(payload.changes(), lambda k, _: ~payload.is_audit_field(k))
    changed = F.when(update, F.array_sort(F.map_keys(delta))).alias("changed")
    moved = payload.is_geometry_only() | (update & F.col("geometry_wkb").isNotNull())
    return state.select("event_id", "operation_type", "created_at", *columns, changed, F.coalesce(moved, F.lit(False)).alias("geometry_changed")), told
