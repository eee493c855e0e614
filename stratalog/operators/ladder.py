"""Which row an event means where its number may have been given to another row since.

A ladder of proofs, each tried only on the events that those before it left over: the captured key, the number with a row
that looks as captured, the one row elsewhere that does, a row that differs in one field, a row by its values alone. Where
all fail the event is refused, or needless. Rows elsewhere are found by digests of what is compared (``claims``), so no
step pairs events with all rows of a shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.operators import claims, targets
from stratalog.session import settled

#: A shape held by more rows than this tells nothing about which one differs in one field only.
FEW = 5
#: Values that a row must share to be recognised by values alone.
LEAST_VALUES = 2
NONE = "map<string,string>"


def _now() -> Column:
    return F.coalesce("_attributes", F.create_map().cast(NONE))


def _told(attributes: Column, keys: tuple[str, ...]) -> Column:
    """The captured values that tell something: no keys, audit fields or nulls."""
    own = F.map_filter(attributes, lambda k, v: ~payload.is_audit_field(k) & (v != "null"))
    return F.map_filter(own, lambda k, _: ~k.isin(*keys)) if keys else own


def _apart(now: Column, wanted: Column) -> Column:
    """The fields that both have with other values."""
    return F.map_keys(F.map_filter(wanted, lambda k, v: F.map_contains_key(now, k) & ~payload.same_value(F.element_at(now, k), v)))


def _alike(now: Column, wanted: Column) -> Column:
    """How many fields both have with the same value."""
    return F.size(F.map_filter(wanted, lambda k, v: F.map_contains_key(now, k) & payload.same_value(F.element_at(now, k), v)))


def _split(events: DataFrame, found: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(event_id, target_fid, stage) of the events that ``found(event_id, target_fid)`` has, and the events that are left."""
    found = settled(found.select("event_id", "target_fid", F.lit(stage).alias("stage")))
    return found, events.join(found, "event_id", "left_anti")


def _differing_in_one(events: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(event_id, target_fid): the highest of at most FEW rows with the event's shape, if all differ in the same one field."""
    shaped = events.where("geometry_wkb IS NOT NULL").select("event_id", "datasource_fingerprint", F.md5("geometry_wkb").alias("h"), _told(payload.old_attributes(), keys).alias("want"))
    held = rows.where("geometry_wkb IS NOT NULL").select("datasource_fingerprint", F.md5("geometry_wkb").alias("h"), "fid", "attributes")
    asked = held.join(shaped.select("datasource_fingerprint", "h").distinct(), ["datasource_fingerprint", "h"], "left_semi")
    few = asked.groupBy("datasource_fingerprint", "h").agg(F.count("*").alias("n")).where(F.col("n") <= FEW)
    held = asked.join(few.select("datasource_fingerprint", "h"), ["datasource_fingerprint", "h"])
    met = shaped.join(held, ["datasource_fingerprint", "h"])
    met = met.groupBy("event_id").agg(F.max("fid").alias("target_fid"), F.collect_set(_apart(F.col("attributes"), F.col("want"))).alias("sets"))
    return met.where((F.size("sets") == 1) & (F.size(F.get("sets", F.lit(0))) == 1))


def removals(events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The row that undoing each insert must take out: (event_id, target_fid, stage).

    Stages: ``key``; ``number`` (the row of that number is as inserted); ``snapshot`` (rows elsewhere have the shape and all
    values, the highest counts, as the latest copy); ``but_one`` (the same but for one field); ``values`` (one row only has
    the values, at least two); ``evidence`` (the row of that number shares the shape or a value); and without a target
    ``gone`` (that row shares nothing) and ``absent``. ``keys`` are key fields, which prove nothing elsewhere.
    """
    met = settled(targets.resolved(events.where("operation_type = 'INSERT'"), rows))
    old, now = payload.old_attributes(), _now()
    same_shape = F.col("_shape").eqNullSafe(F.col("geometry_wkb"))
    by_key, left = _split(met, met.where("found_by = 'pk'"), "key")
    as_inserted = (F.col("found_by") == "fid") & (F.size(_apart(now, old)) == 0) & (F.col("geometry_wkb").isNull() | same_shape)
    by_number, left = _split(left, left.where(as_inserted), "number")
    left = settled(left)  # few are left, and all steps from here on read them
    seen = claims.matched(claims.wanted(left, keys), rows).withColumn("target_fid", F.col("highest"))
    by_snapshot, left = _split(left, seen, "snapshot")
    by_rest, left = _split(left, _differing_in_one(left, rows, keys), "but_one")
    bare = F.lit(None).cast("binary")
    seen = claims.matched(claims.wanted(left, keys, shape=bare, least=LEAST_VALUES), rows).where("n = 1").withColumn("target_fid", F.col("lowest"))
    by_values, left = _split(left, seen, "values")
    shares = (F.col("geometry_wkb").isNotNull() & same_shape) | (_alike(now, _told(old, keys)) > 0)
    kind = F.when(F.col("target_fid").isNull(), "absent").when(shares, "evidence").otherwise("gone")
    rest = left.withColumn("stage", kind).select("event_id", F.when(F.col("stage") == "evidence", F.col("target_fid")).alias("target_fid"), "stage")
    return reduce(DataFrame.unionByName, [by_key, by_number, by_snapshot, by_rest, by_values, rest])


def updates(events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The row that taking back each update must write to: (event_id, target_fid, stage).

    Stages: ``key``; ``number`` (the row of that number is as the update left it); ``elsewhere`` (one row only is, by shape
    and values, or by two values at least where no shape was captured); and without a target ``already_at_old`` (the row of
    that number is as before the update), ``unproven`` and ``absent``.
    """
    met = settled(targets.resolved(events.where("operation_type = 'UPDATE'"), rows))
    by_key, left = _split(met, met.where("found_by = 'pk'"), "key")
    by_number, left = _split(left, left.where(targets.proof().isin(*targets.PROVEN)), "number")
    left = settled(left)  # few are left, and all steps from here on read them
    shaped, bare = left.where("new_geometry_wkb IS NOT NULL"), left.where("new_geometry_wkb IS NULL")
    want = claims.wanted(shaped, keys, payload.new_attributes(), F.col("new_geometry_wkb"), 0)
    want = want.unionByName(claims.wanted(bare, keys, payload.new_attributes(), F.lit(None).cast("binary"), LEAST_VALUES))
    seen = claims.matched(want, rows).where("n = 1").withColumn("target_fid", F.col("lowest"))
    moved, left = _split(left, seen, "elsewhere")
    kind = F.when(F.col("target_fid").isNull(), "absent").when(targets.at_old(), "already_at_old").otherwise("unproven")
    rest = left.select("event_id", F.lit(None).cast("long").alias("target_fid"), kind.alias("stage"))
    return reduce(DataFrame.unionByName, [by_key, by_number, moved, rest])


def moved(events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, moved_fid): events by number whose row is proven to be another one now; a row goes to the first event only."""
    found = removals(events, rows, keys).where("stage IN ('snapshot', 'but_one', 'values')").unionByName(updates(events, rows, keys).where("stage = 'elsewhere'"))
    by_number = events.where(~F.coalesce(targets.has_key(), F.lit(False))).select("event_id", "datasource_fingerprint")
    found = found.join(by_number, "event_id")
    once = found.groupBy("datasource_fingerprint", "target_fid").agg(F.min("event_id").alias("event_id"))
    return once.select("event_id", F.col("target_fid").alias("moved_fid"))
