"""Attribute payloads as columns.

A payload is JSON text of one of three shapes: ``{"all_attributes": {field: value}}``, ``{"changed_only": {field: change}}``
with a change ``{"old": ..., "new": ...}`` (or the older ``[old, new]``), or a trace's marker. Values are kept as JSON
text, so their types survive, and a field that is null is told from one that is absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that databases rewrite on their own, by normalised name.
AUDIT_FIELDS = (
    "audittimestamp",
    "audituser",
    "datemodif",
    "datemodification",
    "lasteditedat",
    "lasteditedby",
    "modifpar",
    "modifiepar",
    "updatedat",
    "updatedby",
)
#: Field type names by family.
TYPE_FAMILIES = {
    "int": ("int4", "integer", "int", "int8", "bigint", "smallint", "int2", "integer64", "int64", "long", "longlong"),
    "real": ("float8", "double", "real", "float4", "numeric", "decimal"),
    "text": ("varchar", "text", "string", "char", "character varying"),
    "bool": ("bool", "boolean"),
    "date": ("date",),
    "time": ("time", "timetz"),
    "timestamp": ("timestamp", "timestamptz", "datetime"),
}
#: Letters with marks and what they are without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(payload: Column | str, name: str) -> Column:
    """A map of field to variant, null where the payload has no such object."""
    return F.try_variant_get(F.try_parse_json(_col(payload)), f"$.{name}", "map<string,variant>")


def _json(value: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(value, path, "variant"))


def full_attributes(payload: Column | str = "attributes_json") -> Column:
    """field -> JSON text of a full payload."""
    return F.transform_values(_part(payload, "all_attributes"), lambda _, v: F.to_json(v))


def _side(value: Column, name: str, place: int) -> Column:
    pair = F.when(_json(value, "$[1]").isNotNull() & _json(value, "$[2]").isNull(), _json(value, f"$[{place}]"))
    return F.coalesce(_json(value, f"$.{name}"), pair, F.to_json(value))


def changes(payload: Column | str = "attributes_json") -> Column:
    """field -> (old, new) JSON texts of a delta."""
    return F.transform_values(
        _part(payload, "changed_only"), lambda _, v: F.struct(_side(v, "old", 0).alias("old"), _side(v, "new", 1).alias("new"))
    )


def inverted(delta: Column) -> Column:
    return F.transform_values(delta, lambda _, v: F.struct(v["new"].alias("old"), v["old"].alias("new")))


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(name), MARKED, PLAIN), "[^a-z0-9]", "")


def is_audit_field(name: Column) -> Column:
    return normalised_name(name).isin(*AUDIT_FIELDS)


def old_attributes(payload: Column | str = "attributes_json") -> Column:
    """State before the event: all attributes, or the old side of a delta without audit fields; {} where unreadable."""
    return _attributes(payload, "old")


def new_attributes(payload: Column | str = "attributes_json") -> Column:
    return _attributes(payload, "new")


def _attributes(payload: Column | str, side: str) -> Column:
    delta = F.transform_values(changes(payload), lambda _, v: v[side])
    delta = F.map_filter(delta, lambda k, _: ~is_audit_field(k))
    return F.coalesce(full_attributes(payload), delta, F.create_map().cast("map<string,string>"))


def is_geometry_only(payload: Column | str = "attributes_json", operation: Column | str = "operation_type") -> Column:
    """An update whose delta has audit fields at most."""
    left = F.map_filter(changes(payload), lambda k, _: ~is_audit_field(k))
    return (_col(operation) == "UPDATE") & (F.coalesce(F.size(left), F.lit(-1)) == 0)


def delta_between(old: Column, new: Column) -> Column:
    """field -> (old, new) of the common fields whose JSON texts differ; null if there are none.

    JSON texts of equal values are equal, of a boolean and a number never, and NaN equals itself.
    """
    common = F.map_filter(old, lambda k, _: F.map_contains_key(new, k))
    both = F.transform_values(common, lambda k, v: F.struct(v.alias("old"), F.element_at(new, k).alias("new")))
    apart = F.map_filter(both, lambda _, v: ~v["old"].eqNullSafe(v["new"]))
    return F.when(F.size(apart) > 0, apart)


def to_payload(delta: Column) -> Column:
    """The JSON payload of a map field -> (old, new)."""
    side = lambda t: F.parse_json(F.coalesce(t, F.lit("null")))
    inner = F.transform_values(delta, lambda _, v: F.to_variant_object(F.create_map(F.lit("old"), side(v["old"]), F.lit("new"), side(v["new"]))))
    return F.to_json(F.to_variant_object(F.create_map(F.lit("changed_only"), F.to_variant_object(inner))))


def to_full_payload(attributes: Column) -> Column:
    """The JSON payload of a map field -> JSON text."""
    inner = F.transform_values(attributes, lambda _, v: F.parse_json(F.coalesce(v, F.lit("null"))))
    return F.to_json(F.to_variant_object(F.create_map(F.lit("all_attributes"), F.to_variant_object(inner))))


def as_text(attributes: Column) -> Column:
    """``field=json`` pairs in order of field, joined by ``;``: a map in a form that compares and hashes."""
    pairs = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def plain(value: Column) -> Column:
    """A JSON text without its quotes; null for JSON null."""
    parsed = F.try_parse_json(value)
    return F.coalesce(F.try_variant_get(parsed, "$", "string"), F.nullif(value, F.lit("null")))


def type_family(name: Column) -> Column:
    """The family of a field type name, case and separators aside; null if unknown."""
    low = F.lower(name)
    out = F.when(F.lit(False), F.lit(""))
    for family, names in TYPE_FAMILIES.items():
        out = out.when(low.isin(*names), family)
    return out


def decoded(value: Column, family: str) -> Column:
    """A JSON text as a typed column; null where it can't be read as that type."""
    text = plain(value)
    if family == "binary":
        return F.when(text.startswith("b64:"), F.try_to_binary(F.substr(text, F.lit(5)), F.lit("base64")))
    kinds = {"int": "long", "real": "double", "text": "string", "bool": "boolean", "date": "date", "timestamp": "timestamp", "time": "string"}
    return text.try_cast(kinds[family])


def cell(value: Column, kind: str) -> Column:
    """A cell of an export: '', 'NULL' and 'null' are null, numbers are null where unreadable."""
    text = plain(value)
    text = F.when(~text.isin("", "NULL", "null"), text)
    return text if kind == "string" else text.try_cast(kind)


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON texts are one value to a layer: the same text, number, instant (a time without an offset is UTC) or
    bytes; a boolean is never a number, and null equals null only."""
    x, y = plain(a), plain(b)
    quoted = lambda c: c.startswith('"')
    numbers = ~quoted(a) & ~quoted(b) & (x.try_cast("double") == y.try_cast("double"))
    dated = r"^\"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
    instants = a.rlike(dated) & b.rlike(dated) & (x.try_cast("timestamp") == y.try_cast("timestamp"))
    both = x.startswith("b64:") & y.startswith("b64:") & (decoded(a, "binary") == decoded(b, "binary"))
    none = (a.isNull() | (a == "null")) & (b.isNull() | (b == "null"))
    return F.coalesce(none | (a == b) | numbers | instants | both, F.lit(False))


def canonical(value: Column) -> Column:
    """A text that is equal for two JSON texts where ``same_value`` holds, so that equal values meet in a join or a digest."""
    x, quoted = plain(value), value.startswith('"')
    number = F.when(~quoted, x.try_cast("double"))
    dated = F.when(value.rlike(r"^\"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.unix_micros(x.try_cast("timestamp")))
    return (
        F.when(value.isNull() | (value == "null"), "null")
        .when(number.isNotNull(), F.concat(F.lit("n"), (number + 0.0).cast("string")))
        .when(dated.isNotNull(), F.concat(F.lit("t"), dated.cast("string")))
        .when(x.startswith("b64:") & decoded(value, "binary").isNotNull(), F.concat(F.lit("b"), F.hex(decoded(value, "binary"))))
        .otherwise(F.concat(F.lit("="), value))
    )
