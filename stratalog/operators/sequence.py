"""Restores of many events one after another: each event meets its row as the events before it left it.

``targets.event_restores`` judges events on rows as they are. A batch writes between its events: of two updates of a row,
the older one is right only once the newer one is taken back. Here the events of a row form a sequence; what an event finds
is the row with the writes of those before it that were carried out.

A row with few events is folded: its events are gathered in order, and each is judged on the row as the last one left it
(``_folded``). Rows with many events, or with much in them, are never gathered; they are judged in rounds, as follows.

Whether a write is carried out may depend on earlier ones (a row found by its number must look as the event left it), so
sequences are judged in rounds. A round assumes that from here on all events of a row are carried out, the next that none
is whose outcome depends on the row's content (events with a key don't); as far as the assumption proves right, and for the
event that breaks it, the verdict is final. So there are as many rounds as a row's events by number change between carried
out and refused, and every round finishes an event of each row left.
Values before an event are ordered scans in two levels (``scans``) over (row, life, field): no sequence is gathered, and
one row with a third of all events is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.operators import claims, ladder, scans, targets
from stratalog.session import settled
from stratalog.sources.journal import order_key

KEYS = ["datasource_fingerprint", "slot"]
LIFE = [*KEYS, "life"]
#: The name of the geometry among the fields of a row.
SHAPE = "\u0000shape"
#: Reasons with which an event was carried out, and their outcomes where they are not failures.
DONE = ("inserted", "deleted", "taken_back")
SKIPPED = ("key_is_there", "twin_is_there", "target_is_gone", "already_at_old")


#: Rows with at most so many events, and so many bytes of payloads and shapes in them, are folded.
FEW, LIGHT = 64, 1 << 20


@dataclass(frozen=True)
class Restored:
    """``events``: event_id, operation_type, slot, target_fid, found_by, reason, outcome; ``cells``: the touched rows (each with a
    slot of its own, as ``rows_after`` names them) that are there in the end, a row for each field (datasource_fingerprint, slot, field, value); ``there``: these rows themselves,
    as one may have neither a field nor a shape."""

    events: DataFrame
    cells: DataFrame
    touched: DataFrame
    there: DataFrame


def _cells(attributes: Column, shape: Column) -> Column:
    """An array of (field, value), the shape in hexadecimal among them."""
    own = F.transform(F.map_entries(attributes), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    drawn = F.array(F.struct(F.lit(SHAPE).alias("field"), F.hex(shape).alias("value")))
    return F.concat(own, F.when(shape.isNotNull(), drawn).otherwise(F.slice(drawn, 1, 0)))


def _order(newest_first: bool) -> list:
    return [F.desc("created_at"), F.desc("event_id")] if newest_first else ["created_at", "event_id"]


def _last(newest_first: bool):
    """The aggregate that gives a column's value at the end of a sequence."""
    return F.min_by if newest_first else F.max_by


def _moved(events: DataFrame, rows: DataFrame, keys: tuple[str, ...], newest_first: bool) -> DataFrame:
    """(datasource_fingerprint, number, moved_fid): numbers whose row has another number now.

    The first event of a number tells, if it is an insert or an update: the rows are as the last edit left them. The others
    follow it, as it is the same row that they meet.
    """
    told = targets.identity_parts(events.where(~F.coalesce(targets.has_key(), F.lit(False)))).where("fid IS NOT NULL")
    first = F.max_by if newest_first else F.min_by
    heads = told.groupBy("datasource_fingerprint", F.col("fid").alias("number")).agg(first(F.struct("event_id", "operation_type"), order_key()).alias("e"))
    heads = settled(heads.select("datasource_fingerprint", "number", "e.event_id", "e.operation_type").where("operation_type IN ('INSERT', 'UPDATE')"))
    found = ladder.moved(events.join(heads.select("event_id"), "event_id", "left_semi"), rows, keys)
    return heads.join(found, "event_id").select("datasource_fingerprint", "number", "moved_fid")


def slots(events: DataFrame, rows: DataFrame, twins: DataFrame, moved: DataFrame, newest_first: bool, parts: int | None) -> DataFrame:
    """``events`` with the row that each is about: ``slot``, ``found_by``, ``target_fid`` and ``twin_fid``.

    An event with a key is about the row of that key, or of none yet. One with a number alone is about the row of that
    number, or where ``moved`` tells that this row has another number now, about that one; but behind a delete of the same number, about the row that this delete brings back under another number, or
    about the twin that made it needless: a number that was given up may be another row's now.
    """
    told = settled(targets.identity_parts(events.select("event_id", "datasource_fingerprint", "created_at", "operation_type", "feature_identity_json")).drop("feature_identity_json"))
    told = targets.located_parts(told, rows).join(twins.select("event_id", F.col("fid").alias("twin_fid")), "event_id", "left")
    keyed = F.coalesce(F.col("pk_field").isNotNull() & F.col("pk_value").isNotNull(), F.lit(False))
    told = told.withColumn("keyed", keyed).withColumn("number", F.when(~F.col("keyed"), F.col("fid")))
    told = told.join(moved, ["datasource_fingerprint", "number"], "left")
    told = told.withColumn("found_by", F.when(F.col("moved_fid").isNotNull(), "content").otherwise(F.col("found_by")))
    told = told.withColumn("target_fid", F.coalesce("moved_fid", "target_fid"))
    base = ["event_id", "datasource_fingerprint", "created_at", "operation_type", "keyed", "number", "pk_field", "pk_value", "target_fid", "found_by", "twin_fid"]
    told = settled(told.select(*base))  # read twice, and once more to find the ranges
    by, order = ["datasource_fingerprint", "number"], _order(newest_first)
    numbered = scans.bucketed(told.where("number IS NOT NULL"), by, order, parts)
    gone = F.when(F.col("operation_type") == "DELETE", F.struct("event_id", "twin_fid"))
    summary = lambda x: x.groupBy(scans.BUCKET, *by).agg(_last(newest_first)(gone, F.when(gone.isNotNull(), order_key())).alias("gone"))
    numbered = scans.carried(numbered, by, summary, {"_gone": F.last("gone", ignorenulls=True).over(scans.earlier(by))})
    before = F.last(gone, ignorenulls=True).over(scans.line(by, order).rowsBetween(Window.unboundedPreceding, -1))
    numbered = numbered.withColumn("_gone", F.coalesce(before, F.col("_gone"))).drop(scans.BUCKET)
    both = numbered.unionByName(told.where("number IS NULL"), allowMissingColumns=True)
    name = lambda kind, *x: F.concat_ws("\u0001", F.lit(kind), *[F.col(c).cast("string") for c in x])
    again, is_delete = F.col("_gone").isNotNull(), F.col("operation_type") == "DELETE"
    slot = (
        F.when(F.col("keyed"), F.when(F.col("target_fid").isNotNull(), name("row", "target_fid")).otherwise(name("key", "pk_field", "pk_value")))
        .when(F.col("number").isNull(), name("none", "event_id"))
        .when(is_delete, name("new", "event_id"))
        .when(again & F.col("_gone.twin_fid").isNotNull(), name("row", "_gone.twin_fid"))
        .when(again, name("new", "_gone.event_id"))
        .when(F.col("target_fid").isNotNull(), name("row", "target_fid"))
        .otherwise(name("fid", "number"))
    )
    return both.withColumn("slot", slot).select(*base, "slot")


def _number(fid: str = "fid") -> Column:
    return F.concat_ws("\u0001", F.lit("row"), F.col(fid).cast("string"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose number others have too, with ``slot`` and ``own``: the slot of each row alone."""
    by = ["datasource_fingerprint", "fid"]
    several = rows.where("fid IS NOT NULL").groupBy(*by).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*by)
    # Rows that are equal in all may change places.
    told = Window.partitionBy(*by).orderBy(F.array_sort(F.map_entries("attributes")), "geometry_wkb")
    more = rows.join(several, by, "left_semi").withColumn("slot", _number())
    return more.withColumn("own", F.concat_ws("\u0001", "slot", F.row_number().over(told).cast("string")))


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``slot`` of each, which no two rows of a number share."""
    more = _shared(rows)
    alone = rows.join(more.select("datasource_fingerprint", "fid").distinct(), ["datasource_fingerprint", "fid"], "left_anti")
    return alone.withColumn("slot", _number()).unionByName(more.drop("slot").withColumnRenamed("own", "slot"))


def _told_apart(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """``placed`` events once for each row that they are about: of several rows of a number, those with the event's key, or
    without a key all of them."""
    more = _shared(rows).select(*KEYS, "own", F.col("attributes").alias("_attributes"))
    held = payload.plain(F.try_element_at("_attributes", F.col("pk_field")))
    fits = F.col("own").isNull() | ~F.col("keyed") | held.eqNullSafe(F.col("pk_value"))
    met = placed.dropDuplicates(["event_id"]).join(more, KEYS, "left").where(fits)
    return met.withColumn("slot", F.coalesce("own", "slot")).drop("own", "_attributes")


def _by_number(slot: Column) -> Column:
    """A slot without what tells rows of one number apart."""
    return F.when(slot.startswith("row\u0001"), F.substring_index(slot, "\u0001", 2)).otherwise(slot)


def _sure() -> Column:
    """Whether an event that finds its row there, or not, is carried out whatever the row's content is."""
    return F.col("keyed") | (F.col("operation_type") == "DELETE")


def _presence(events: DataFrame, base: DataFrame, assume: bool, newest_first: bool) -> DataFrame:
    """``events`` with ``before``: whether the row is there, and ``life``: the event that brought it (0: it was there)."""
    op = F.col("operation_type")
    turn = F.when((op == "DELETE") & F.col("twin_fid").isNull(), True).when((op == "INSERT") & (F.lit(assume) | _sure()), False)
    events = events.join(base, KEYS, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    line = scans.line(KEYS, _order(newest_first)).rowsBetween(Window.unboundedPreceding, -1)
    at_end = lambda x, c, name: x.groupBy(scans.BUCKET, *KEYS).agg(_last(newest_first)(c, F.when(c.isNotNull(), order_key())).alias(name))
    events = scans.carried(events, KEYS, lambda x: at_end(x, turn, "turn"), {"_turn": F.last("turn", ignorenulls=True).over(scans.earlier(KEYS))})
    events = settled(events.withColumn("before", F.coalesce(F.last(turn, ignorenulls=True).over(line), F.col("_turn"), F.col("present"))).drop("_turn", "present"))
    born = F.when(_born(), F.col("event_id"))
    events = scans.carried(events, KEYS, lambda x: at_end(x, born, "born"), {"_born": F.last("born", ignorenulls=True).over(scans.earlier(KEYS))})
    return events.withColumn("life", F.coalesce(F.last(born, ignorenulls=True).over(line), F.col("_born"), F.lit(0))).drop("_born")


def _born() -> Column:
    return (F.col("operation_type") == "DELETE") & F.col("twin_fid").isNull() & ~F.col("before")


def _found(events: DataFrame, cells: DataFrame, start: DataFrame, assume: bool, newest_first: bool, parts: int | None) -> DataFrame:
    """For each event and field that it names: ``there``, and the value that the event finds, ``now``."""
    named = events.select(*LIFE, "created_at", "event_id", "operation_type", "before", "keyed").join(cells, "event_id")
    write = F.when((F.col("operation_type") == "UPDATE") & F.col("before") & (F.lit(assume) | _sure()), F.col("old"))
    by, order = [*LIFE, "field"], _order(newest_first)
    named = scans.bucketed(named, by, order, parts)
    summary = lambda x: x.groupBy(scans.BUCKET, *by).agg(_last(newest_first)(write, F.when(write.isNotNull(), order_key())).alias("w"))
    named = scans.carried(named, by, summary, {"_w": F.last("w", ignorenulls=True).over(scans.earlier(by))})
    line = scans.line(by, order).rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("_w", F.coalesce(F.last(write, ignorenulls=True).over(line), F.col("_w")))
    named = named.join(start.select(*by, F.struct("value").alias("_s")), by, "left")
    known = F.col("_s").isNotNull() | ((F.col("field") == SHAPE) & F.col("_w").isNotNull())
    return named.withColumns({"there": known, "now": F.coalesce("_w", "_s")})


def _verdicts(events: DataFrame, found: DataFrame) -> DataFrame:
    """``events`` with the ``reason`` of each, by the state that it finds."""
    shape, old, new, now, there = F.col("field") == SHAPE, F.col("old"), F.col("new"), F.col("now"), F.col("there")
    same = lambda x: F.when(shape, now["value"].eqNullSafe(x["value"])).otherwise(payload.same_value(now["value"], x["value"]))
    seen = found.groupBy("event_id").agg(
        F.count_if(~shape & old.isNotNull()).alias("n_old"),
        F.count_if(~shape & old.isNotNull() & there).alias("old_there"),
        F.count_if(old.isNotNull() & F.when(shape, ~there | ~same(old)).otherwise(there & ~same(old))).alias("old_apart"),
        F.count_if(shape & old.isNotNull()).alias("old_shape"),
        F.count_if(~shape & new.isNotNull()).alias("n_new"),
        F.count_if(~shape & new.isNotNull() & there).alias("new_there"),
        F.count_if(~shape & new.isNotNull() & there & ~same(new)).alias("new_apart"),
        F.count_if(shape & new.isNotNull()).alias("new_shape"),
        F.count_if(shape & new.isNotNull() & (~there | ~same(new))).alias("new_moved"),
    )
    events = events.join(seen, "event_id", "left").fillna(0, [x for x in seen.columns if x != "event_id"])
    op, before, keyed = F.col("operation_type"), F.col("before"), F.col("keyed")
    at_old = (F.col("old_there") == F.col("n_old")) & (F.col("old_apart") == 0) & ((F.col("n_old") > 0) | (F.col("old_shape") > 0))
    as_left = (F.col("new_there") > 0) & (F.col("new_apart") == 0) & (F.col("new_moved") == 0)
    update = (
        F.when(~before, "target_absent")
        .when(at_old, "already_at_old")
        .when(keyed, "taken_back")
        .when(F.col("new_shape") > 0, F.when(F.col("new_moved") == 0, "taken_back").otherwise("geometry_mismatch"))
        .when(F.col("n_new") == 0, "nothing_captured")
        .when(F.col("new_there") == 0, "nothing_to_compare")
        .when(F.col("new_apart") == 0, "taken_back")
        .otherwise("attribute_mismatch")
    )
    reason = (
        F.when(op == "DELETE", F.when(before, "key_is_there").when(F.col("twin_fid").isNotNull(), "twin_is_there").otherwise("inserted"))
        .when(op == "INSERT", F.when(~before, "target_is_gone").when(keyed | as_left, "deleted").otherwise("only_the_number_matches"))
        .when(op == "UPDATE", update)
        .otherwise("unsupported_operation")
    )
    return events.withColumn("reason", reason).drop(*[x for x in seen.columns if x != "event_id"])


def _left(judged: DataFrame, assume: bool, newest_first: bool) -> DataFrame:
    """``judged`` with ``final``: nothing before the event went against the assumption."""
    done = F.col("reason").isin(*DONE)
    refused = (F.col("operation_type") == "UPDATE") & ~done & (F.col("reason") != "already_at_old") | (F.col("reason") == "only_the_number_matches")
    broken = F.col("before") & refused if assume else done & ~_sure()
    judged = settled(judged.withColumn("_broken", broken.cast("long")))
    total = lambda x: x.groupBy(scans.BUCKET, *KEYS).agg(F.sum("_broken").alias("n"))
    judged = scans.carried(judged, KEYS, total, {"_n": F.sum("n").over(scans.earlier(KEYS))})
    line = scans.line(KEYS, _order(newest_first)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_broken").over(line), F.lit(0)) + F.coalesce("_n", F.lit(0))
    return judged.withColumn("final", before == 0).drop("_broken", "_n")


def _judged_by(state: Column, e: Column) -> Column:
    """The reason of event ``e`` on a row's ``state`` (present, cells: field -> value); as ``_verdicts``."""
    has = lambda x: F.map_contains_key(state["cells"], x["field"])
    is_shape = lambda x: x["field"] == SHAPE
    now = lambda x: F.element_at(state["cells"], x["field"])
    same = lambda x: F.when(is_shape(x), now(x).eqNullSafe(x["value"])).otherwise(payload.same_value(now(x), x["value"]))
    at_old = (F.size(e["old"]) > 0) & F.forall(e["old"], lambda x: has(x) & same(x))
    drawn_so = F.forall(e["new"], lambda x: ~is_shape(x) | (has(x) & same(x)))
    shared = F.exists(e["new"], lambda x: ~is_shape(x) & has(x))
    valued_so = F.forall(e["new"], lambda x: is_shape(x) | ~has(x) | same(x))
    before, keyed, op = state["present"], e["keyed"], e["operation_type"]
    update = (
        F.when(~before, "target_absent")
        .when(at_old, "already_at_old")
        .when(keyed, "taken_back")
        .when(F.exists(e["new"], is_shape), F.when(drawn_so, "taken_back").otherwise("geometry_mismatch"))
        .when(F.size(e["new"]) == 0, "nothing_captured")
        .when(~shared, "nothing_to_compare")
        .when(valued_so, "taken_back")
        .otherwise("attribute_mismatch")
    )
    return (
        F.when(op == "DELETE", F.when(before, "key_is_there").when(e["twin_fid"].isNotNull(), "twin_is_there").otherwise("inserted"))
        .when(op == "INSERT", F.when(~before, "target_is_gone").when(keyed | (shared & drawn_so & valued_so), "deleted").otherwise("only_the_number_matches"))
        .when(op == "UPDATE", update)
        .otherwise("unsupported_operation")
    )


def _left_by(state: Column, e: Column, reason: Column) -> Column:
    """A row's ``state`` behind event ``e``: a write sets fields that the row has, and the shape."""
    old, cells = F.map_from_entries(e["old"]), state["cells"]
    written = F.transform_values(cells, lambda k, v: F.when(F.map_contains_key(old, k), F.element_at(old, k)).otherwise(v))
    drawn = F.map_contains_key(old, F.lit(SHAPE)) & ~F.map_contains_key(cells, F.lit(SHAPE))
    written = F.when(drawn, F.map_concat(written, F.create_map(F.lit(SHAPE), F.element_at(old, F.lit(SHAPE))))).otherwise(written)
    return F.struct(
        F.when(reason == "inserted", True).when(reason == "deleted", False).otherwise(state["present"]).alias("present"),
        F.when(reason == "inserted", old).when(reason == "taken_back", written).otherwise(cells).alias("cells"),
        F.concat(state["reasons"], F.array(reason)).alias("reasons"),
    )


def _folded(placed: DataFrame, sides: DataFrame, held: DataFrame, newest_first: bool) -> DataFrame:
    """A row for each slot: KEYS, ``events`` in order, and ``end``: whether the row is there, its cells and the events' reasons."""
    told = ["event_id", "operation_type", "target_fid", "found_by"]
    events = placed.join(sides.select("event_id", F.col("o").alias("old"), F.col("n").alias("new")), "event_id")
    events = events.groupBy(*KEYS).agg(F.collect_list(F.struct("created_at", *told, "keyed", "twin_fid", "old", "new")).alias("e"))
    start = held.select(*KEYS, F.map_from_entries("x").alias("cells"))
    met = events.withColumn("e", F.sort_array("e", not newest_first)).join(start, KEYS, "left")
    begin = F.struct(
        F.col("cells").isNotNull().alias("present"),
        F.coalesce("cells", F.create_map().cast("map<string,string>")).alias("cells"),
        F.array().cast("array<string>").alias("reasons"),
    )
    # An array of one: the reason is worked out once for all that follows from it.
    step = lambda s, e: F.get(F.transform(F.array(_judged_by(s, e)), lambda r: _left_by(s, e, r)), F.lit(0))
    short = F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in ("created_at", *told)]))
    return met.select(*KEYS, short.alias("events"), F.aggregate("e", begin, step).alias("end"))


def restored(
    events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = (), newest_first: bool = True, claim: bool = True, relocate: bool = False, parts: int | None = None, few: int = FEW
) -> Restored:
    """Restores ``events`` in order on ``rows`` (datasource_fingerprint, fid, attributes, geometry_wkb).

    Rules are those of ``targets.event_restores``, with the row as it is by then. A row is a twin of one delete at most
    (``claims``), unless ``claim`` is off: then no twins are looked for. With ``relocate``, events by number whose row has
    another number now follow it as far as the ladder of proofs finds it (``ladder``). ``keys`` are key fields, which a twin
    needn't share. Rows with more than ``few`` events are judged in rounds. Rows of one number are rows of their own: an event
    by number comes once for each of them, one with a key for those that have it.
    """
    deletes = events.where("operation_type = 'DELETE'")
    found = claims.claimed_twins(deletes, rows, keys, newest_first, parts) if claim else deletes.select("datasource_fingerprint", "event_id", F.lit(None).cast("long").alias("fid")).limit(0)
    nowhere = events.sparkSession.createDataFrame([], "datasource_fingerprint string, number long, moved_fid long")
    moved = settled(_moved(events, rows, keys, newest_first)) if relocate else nowhere
    placed = slots(events, rows, found, moved, newest_first, parts)
    placed = settled(_told_apart(placed, rows))
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("attributes_json", "geometry_wkb", "new_geometry_wkb")), F.lit(0)).cast("long")
    sides = events.select("event_id", _cells(payload.old_attributes(), F.col("geometry_wkb")).alias("o"), _cells(payload.new_attributes(), F.col("new_geometry_wkb")).alias("n"), weight.alias("w"))
    sides = settled(sides)
    weighed = placed.join(sides.select("event_id", "w"), "event_id").groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    weighed = settled(weighed.select(*KEYS, ((F.col("n") <= few) & (F.col("w") <= LIGHT)).alias("light")))
    touched, heavy = weighed.select(*KEYS), weighed.where("NOT light").select(*KEYS)
    held = _named(rows).select(*KEYS, _cells(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.col("geometry_wkb")).alias("x"))
    folded = settled(_folded(placed.join(heavy, KEYS, "left_anti"), sides, held.join(heavy, KEYS, "left_anti"), newest_first))
    each = folded.select(*KEYS, F.posexplode("events").alias("_at", "e"), F.col("end.reasons").alias("_all"))
    judged = each.select(*KEYS, "e.*", F.get("_all", F.col("_at")).alias("reason"))
    there = folded.where("end.present")
    ends, there = there.select(*KEYS, F.explode("end.cells").alias("field", "value")), there.select(*KEYS)
    if not heavy.isEmpty():
        base = [*KEYS, "event_id", "created_at", "operation_type", "target_fid", "found_by"]
        rest = _rounds(placed.join(heavy, KEYS, "left_semi"), sides, held.join(heavy, KEYS, "left_semi"), newest_first, parts)
        judged = judged.unionByName(rest[0].select(*base, "reason"))
        ends, there = ends.unionByName(rest[1]), there.unionByName(rest[2])
    outcome = (
        F.when(F.col("reason").isin(*DONE), "applied")
        .when(F.col("reason").isin(*SKIPPED), "skipped_idempotent")
        .when(F.col("reason") == "geometry_mismatch", "failed_geometry_drift")
        .when(F.col("reason") == "unsupported_operation", "failed")
        .otherwise("failed_target_absent")
    )
    judged = judged.select("event_id", "datasource_fingerprint", "created_at", "operation_type", _by_number(F.col("slot")).alias("slot"), "target_fid", "found_by", "reason", outcome.alias("outcome"))
    return Restored(judged, ends, touched, there)


def _rounds(placed: DataFrame, sides: DataFrame, held: DataFrame, newest_first: bool, parts: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with their reasons, cells of the rows that are there in the end, and these rows, judged in rounds."""
    left = scans.bucketed(placed, KEYS, _order(newest_first), parts)
    ids = placed.select("event_id").distinct()
    side = lambda c, name: sides.join(ids, "event_id", "left_semi").select("event_id", F.explode(c).alias("x")).select("event_id", "x.field", F.struct("x.value").alias(name))
    cells = settled(side("o", "old").join(side("n", "new"), ["event_id", "field"], "full_outer"))
    held = settled(held)
    base, start = held.select(*KEYS, F.lit(True).alias("present")), held.select(*KEYS, F.explode("x").alias("x")).select(*KEYS, "x.field", "x.value")
    judged, ends, there, assume = None, None, None, True
    while True:
        now = settled(_presence(left, base, assume, newest_first))
        image = now.where(_born()).select(*KEYS, F.col("event_id").alias("life"), "event_id").join(cells.where("old IS NOT NULL"), "event_id")
        begin = start.withColumn("life", F.lit(0).cast("long")).unionByName(image.select(*LIFE, "field", "old.value"))
        seen = settled(_found(now, cells, begin, assume, newest_first, parts))
        now = settled(_left(_verdicts(now, seen), assume, newest_first))
        final = now.where("final")
        judged = final if judged is None else judged.unionByName(final)
        # The state behind the last final event of each row.
        reason = F.col("reason")
        present = F.when(reason == "inserted", True).when(reason == "deleted", False).otherwise(F.col("before"))
        life = F.when(reason == "inserted", F.col("event_id")).otherwise(F.col("life"))
        end = final.groupBy(*KEYS).agg(_last(newest_first)(F.struct(present.alias("present"), life.alias("life")), order_key()).alias("e"))
        end = settled(end.select(*KEYS, "e.present", "e.life"))
        alive = end.where("present").select(*LIFE)
        writes = seen.join(final.where(reason == "taken_back").select("event_id"), "event_id", "left_semi").where("old IS NOT NULL")
        writes = writes.groupBy(*LIFE, "field").agg(_last(newest_first)("old", order_key()).alias("w")).join(alive, LIFE, "left_semi")
        over = begin.join(alive, LIFE, "left_semi").select(*LIFE, "field", F.struct("value").alias("s")).join(writes, [*LIFE, "field"], "full_outer")
        over = over.where(F.col("s").isNotNull() | (F.col("field") == SHAPE)).select(*KEYS, "field", F.coalesce("w", "s")["value"].alias("value"))
        left = now.where("NOT final").drop("before", "life", "reason", "final")
        open_slots = settled(left.select(*KEYS).distinct())
        closed = over.join(open_slots, KEYS, "left_anti")
        ends = closed if ends is None else ends.unionByName(closed)
        stays = end.where("present").select(*KEYS).join(open_slots, KEYS, "left_anti")
        there = stays if there is None else there.unionByName(stays)
        if open_slots.isEmpty():
            break
        base, start = end.select(*KEYS, "present").join(open_slots, KEYS, "left_semi"), settled(over.join(open_slots, KEYS, "left_semi"))
        left, assume = settled(left), not assume
    return judged, ends, there


def rows_after(rows: DataFrame, done: Restored) -> DataFrame:
    """The rows behind a batch: fid, attributes, geometry_wkb, and ``brought_by``, the event that inserted one (fid is null)."""
    kind = F.split("slot", "\u0001")
    rest = _named(rows).join(done.touched, KEYS, "left_anti")
    rest = rest.select("datasource_fingerprint", "slot", "fid", "attributes", "geometry_wkb")
    pairs = F.collect_list(F.when(F.col("field") != SHAPE, F.struct("field", "value")))
    whole = done.cells.groupBy(*KEYS).agg(pairs.alias("pairs"), F.max(F.when(F.col("field") == SHAPE, F.col("value"))).alias("shape"))
    whole = done.there.join(whole, KEYS, "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<field:string,value:string>>")))
    fid = F.when(kind[0] == "row", kind[1].cast("long"))
    whole = whole.select("datasource_fingerprint", "slot", fid.alias("fid"), F.map_from_entries("pairs").alias("attributes"), F.unhex("shape").alias("geometry_wkb"))
    return rest.unionByName(whole).withColumn("slot", _by_number(F.col("slot")))


def session_undo(journal: DataFrame, session: str, rows: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> Restored:
    """``restored`` of all user events of a session, the newest first."""
    from stratalog.sources.journal import is_trace

    return restored(journal.where((F.col("session_id") == session) & ~is_trace()), rows, keys, parts=parts)
