"""Schema drift: captured fields against present ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import payload

FIELDS = "array<struct<name:string,type:string,length:int,precision:int>>"


def captured_fields(events: DataFrame) -> DataFrame:
    """(datasource_fingerprint, name, type) of all field schemas, distinct; an unreadable schema has no fields.

    Schemas repeat in nearly all events, so they are made distinct as text before they are parsed.
    """
    texts = events.select("datasource_fingerprint", "field_schema_json").where("field_schema_json IS NOT NULL").distinct()
    fields = texts.select("datasource_fingerprint", F.explode(F.from_json("field_schema_json", FIELDS)).alias("f"))
    return fields.where("f.name IS NOT NULL").select("datasource_fingerprint", F.col("f.name").alias("name"), F.col("f.type").alias("type")).distinct()


def compatible(a: Column, b: Column) -> Column:
    family = payload.type_family(a)
    return (F.lower(a) == F.lower(b)) | F.coalesce(family == payload.type_family(b), F.lit(False))


def compare(captured: DataFrame, present: DataFrame) -> DataFrame:
    """(datasource_fingerprint, name, old_type, new_type, verdict): matched, missing, added or type_changed."""
    old = captured.select("datasource_fingerprint", "name", F.col("type").alias("old_type"), F.lit(True).alias("was"))
    new = present.select("datasource_fingerprint", "name", F.col("type").alias("new_type"), F.lit(True).alias("is"))
    met = old.join(new, ["datasource_fingerprint", "name"], "full_outer")
    verdict = (
        F.when(F.col("is").isNull(), "missing")
        .when(F.col("was").isNull(), "added")
        .when(compatible(F.col("old_type"), F.col("new_type")), "matched")
        .otherwise("type_changed")
    )
    return met.select("datasource_fingerprint", "name", "old_type", "new_type", verdict.alias("verdict"))


def dropped_fields(compared: DataFrame) -> DataFrame:
    """Captured fields that can't be written back, with the reason."""
    reason = F.when(F.col("verdict") == "missing", "no such field").otherwise(F.concat(F.col("old_type"), F.lit(" -> "), F.col("new_type")))
    return compared.where("verdict IN ('missing', 'type_changed')").select("datasource_fingerprint", "name", reason.alias("reason"))


def is_compatible(compared: DataFrame) -> DataFrame:
    """(datasource_fingerprint, n_matched, n_lost, compatible): sources that a restore may write."""
    lost = F.count_if(F.col("verdict").isin("missing", "type_changed"))
    return compared.groupBy("datasource_fingerprint").agg(F.count_if(F.col("verdict") == "matched").alias("n_matched"), lost.alias("n_lost"), (lost == 0).alias("compatible"))


def restorable(events: DataFrame, compared: DataFrame) -> DataFrame:
    """(event_id, field, value): the captured old values that can be written back."""
    cells = events.select("event_id", "datasource_fingerprint", F.explode(payload.old_attributes()).alias("field", "value"))
    good = compared.where("verdict = 'matched'").select("datasource_fingerprint", F.col("name").alias("field"))
    return cells.where(~payload.is_audit_field(F.col("field"))).join(good.distinct(), ["datasource_fingerprint", "field"], "left_semi").select("event_id", "field", "value")


def field_mapping(compared: DataFrame) -> DataFrame:
    """(datasource_fingerprint, mapping): captured name -> present name of the matched and the missing fields.

    Missing fields stay in the mapping, so that what can't be written is reported; fields of another type don't.
    """
    named = compared.where("verdict IN ('matched', 'missing')").select("datasource_fingerprint", "name").distinct()
    return named.groupBy("datasource_fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("name").alias("to"))))).alias("mapping"))


def mapped_values(events: DataFrame, compared: DataFrame) -> DataFrame:
    """(event_id, field, family, text, number, truth, moment, bytes): ``restorable`` values in the type of their present field.

    One of the typed columns holds the value, by the field's family; one that can't be read as that is kept as text.
    """
    types = compared.where("verdict = 'matched'").select("datasource_fingerprint", F.col("name").alias("field"), payload.type_family(F.col("new_type")).alias("family"))
    rows = restorable(events, compared).join(events.select("event_id", "datasource_fingerprint"), "event_id")
    rows = rows.join(types.distinct(), ["datasource_fingerprint", "field"])
    v, family = F.col("value"), F.col("family")
    typed = {
        "number": F.when(family.isin("int", "real"), payload.decoded(v, "real")),
        "truth": F.when(family == "bool", payload.decoded(v, "bool")),
        "moment": F.when(family.isin("date", "timestamp"), payload.decoded(v, "timestamp")),
        "bytes": payload.decoded(v, "binary"),
    }
    return rows.select("event_id", "field", "family", F.when(F.coalesce(*[c.cast("string") for c in typed.values()]).isNull(), payload.plain(v)).alias("text"), *[c.alias(k) for k, c in typed.items()])
