"""Rows that deleted entities already are, each row claimed by one event at most.

A delete is not inserted again where a row has its shape and all its captured values. Events and rows that are equal in
this sense form a class: all events of a class fit all its rows. So no pairs are made: within a class the first event
takes the lowest row, the second the next one. Classes overlap where events captured different fields; a row wanted by
several goes to the first event, and the others try the rows that are left, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.operators import scans
from stratalog.session import settled
from stratalog.sources.journal import order_key

CLASS = ["datasource_fingerprint", "fields", "with_shape", "content"]
#: Tells rows apart that have the same number.
COPY = "_copy"


def _content(fields: Column, attributes: Column, shape: Column) -> Column:
    """A digest of the values of ``fields`` and the shape; equal where all values are the same to a layer."""
    values = F.transform(fields, lambda f: payload.canonical(F.element_at(attributes, f)))
    return F.sha2(F.to_json(F.struct(values.alias("v"), F.hex(shape).alias("s"))), 256)


def wanted(events: DataFrame, keys: tuple[str, ...] = (), attributes: Column | None = None, shape: Column | None = None, least: int = 1) -> DataFrame:
    """(datasource_fingerprint, event_id, created_at, fields, with_shape, content) of events that have something to compare.

    ``attributes`` and ``shape`` are what a row should have, by default the old side of an event. Values of ``keys``, audit
    fields and nulls don't count, and ``least`` others must be there: a geometry alone proves nothing.
    """
    attributes = payload.old_attributes() if attributes is None else attributes
    shape = F.col("geometry_wkb") if shape is None else shape
    own = F.map_filter(attributes, lambda k, v: ~payload.is_audit_field(k) & (v != "null") & ~k.isin(*keys) if keys else ~payload.is_audit_field(k) & (v != "null"))
    want = events.select("datasource_fingerprint", "event_id", "created_at", shape.alias("shape"), own.alias("want")).where(F.size("want") >= least)
    want = want.withColumns({"fields": F.array_sort(F.map_keys("want")), "with_shape": F.col("shape").isNotNull()})
    return want.select("datasource_fingerprint", "event_id", "created_at", "fields", "with_shape", _content(F.col("fields"), F.col("want"), F.col("shape")).alias("content"))


def offered(rows: DataFrame, want: DataFrame) -> DataFrame:
    """(datasource_fingerprint, fid, fields, with_shape, content): each row by each set of fields that events captured there.

    Rows meet sets of fields, of which a source has as many as its schema had forms, never events.
    """
    sets = want.select("datasource_fingerprint", "fields", "with_shape").distinct()
    copy = [c for c in rows.columns if c == COPY]
    met = rows.select("datasource_fingerprint", "fid", *copy, "attributes", "geometry_wkb").join(sets, "datasource_fingerprint")
    met = met.where(F.forall("fields", lambda f: F.map_contains_key("attributes", f)) & (~F.col("with_shape") | F.col("geometry_wkb").isNotNull()))
    shape = F.when(F.col("with_shape"), F.col("geometry_wkb"))
    return met.select("datasource_fingerprint", "fid", *copy, "fields", "with_shape", _content(F.col("fields"), F.col("attributes"), shape).alias("content"))


def twins(events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, twin_fid): the lowest row that is each event's, whoever else wants it."""
    want = wanted(events, keys)
    return matched(want, rows).select("event_id", F.col("lowest").alias("twin_fid"))


def matched(want: DataFrame, rows: DataFrame) -> DataFrame:
    """(event_id, lowest, highest, n): the rows of each event's class, as their lowest and highest number and how many."""
    want = settled(want)  # digests are worked out once, for the sets of fields and the join
    offer = offered(rows, want).groupBy(*CLASS).agg(F.min("fid").alias("lowest"), F.max("fid").alias("highest"), F.count("*").alias("n"))
    return want.join(offer, CLASS).select("event_id", "lowest", "highest", "n")


def ranked(rows: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in each group, however large."""
    dealt = scans.bucketed(rows, keys, order, parts)
    count = lambda x: x.groupBy(scans.BUCKET, *keys).agg(F.count("*").alias("n"))
    dealt = scans.carried(dealt, keys, count, {"_n": F.sum("n").over(scans.earlier(keys))})
    place = F.row_number().over(scans.line(keys, order)) + F.coalesce("_n", F.lit(0))
    return dealt.withColumn("rank", place).drop(scans.BUCKET, "_n")


def claims(want: DataFrame, offer: DataFrame, newest_first: bool = True, parts: int | None = None) -> DataFrame:
    """(datasource_fingerprint, event_id, fid): one row for an event and one event for a row. Rows of one number are told
    apart by ``_copy`` if ``offer`` has it.

    ``want`` (of ``wanted``) and ``offer`` (of ``offered``) share CLASS. In each round the n-th event of a class asks for
    the n-th lowest row that is free; a row goes to the first event of those that ask for it. Rounds go on while rows are
    asked for: more than one only where classes overlap.
    """
    order = [F.desc("created_at"), F.desc("event_id")] if newest_first else ["created_at", "event_id"]
    first = F.max_by if newest_first else F.min_by
    offer = offer if COPY in offer.columns else offer.withColumn(COPY, F.lit(1))
    row = ["datasource_fingerprint", "fid", COPY]
    want, offer, found = want.select(*CLASS, "created_at", "event_id"), offer.select(*CLASS, "fid", COPY), None
    while True:
        met = ranked(want, CLASS, order, parts).join(ranked(offer, CLASS, ["fid", COPY], parts), [*CLASS, "rank"])
        won = settled(met.groupBy(*row).agg(first("event_id", order_key()).alias("event_id")))
        found = won if found is None else found.unionByName(won)
        if won.isEmpty():
            return found.drop(COPY)
        want = settled(want.join(won.select("event_id"), "event_id", "left_anti"))
        offer = settled(offer.join(won.select(*row), row, "left_anti"))


def claimed_twins(events: DataFrame, rows: DataFrame, keys: tuple[str, ...] = (), newest_first: bool = True, parts: int | None = None) -> DataFrame:
    """(datasource_fingerprint, event_id, fid): deleted entities that rows already are, no row for two of them."""
    want = settled(wanted(events, keys))
    same = Window.partitionBy("datasource_fingerprint", "fid").orderBy(F.xxhash64(F.map_entries("attributes"), "geometry_wkb"))
    rows = rows.withColumn(COPY, F.row_number().over(same))
    return claims(want, offered(rows, want), newest_first, parts)
