"""Sources under several names: alias edges, their closure and their final targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import identity

#: Alias chains are followed over so many edges.
DEPTH = 8


def add_alias(aliases: DataFrame, alias: str, target: str, now: str, note: str = "") -> DataFrame:
    """The edges with one more; an edge to itself or one that closes a circle is refused."""
    if alias == target:
        raise ValueError("a source can't be an alias of itself")
    if family(aliases).where((F.col("member") == alias) & (F.col("fingerprint") == target)).limit(1).count():
        raise ValueError("the two are in one family already; another edge would close a circle")
    row = aliases.sparkSession.createDataFrame([(alias, target, now, note)], "alias_fingerprint string, target_fingerprint string, created_at string, note string")
    return remove_alias(aliases, alias).unionByName(row)


def remove_alias(aliases: DataFrame, alias: str) -> DataFrame:
    return aliases.where(F.col("alias_fingerprint") != alias)


def _edges(aliases: DataFrame) -> DataFrame:
    return aliases.select("alias_fingerprint", "target_fingerprint").where("alias_fingerprint <> target_fingerprint")


def family(aliases: DataFrame) -> DataFrame:
    """(fingerprint, member): each fingerprint of the alias table with all that lie within eight edges, either way.

    Three doublings of the reach instead of eight steps; the alias table is a few rows a source.
    """
    direct = _edges(aliases).toDF("fingerprint", "member")
    both = direct.union(direct.select("member", "fingerprint"))
    own = both.select("fingerprint", F.col("fingerprint").alias("member"))
    reach = both.union(own).distinct()
    for _ in range(DEPTH.bit_length() - 1):
        further = reach.select(F.col("fingerprint").alias("member"), F.col("member").alias("far"))
        reach = reach.join(further, "member").select("fingerprint", F.col("far").alias("member")).distinct()
    return reach


def expanded(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(fingerprint)`` with all names of each: (fingerprint, member), itself included."""
    reach = wanted.join(family(aliases), "fingerprint", "left").select("fingerprint", F.coalesce("member", "fingerprint").alias("member"))
    return reach.union(wanted.select("fingerprint", "fingerprint")).distinct()


def final_targets(aliases: DataFrame) -> DataFrame:
    """(alias, target): the end of each alias's chain, at most eight edges past its first; circles end before they close."""
    direct = _edges(aliases).toDF("alias", "target")
    now = direct.select("alias", "target", F.array("alias").alias("seen"))
    step = direct.select(F.col("alias").alias("at"), F.col("target").alias("further"))
    for _ in range(DEPTH):
        met = now.join(step, now["target"] == step["at"], "left")
        go = F.col("further").isNotNull() & ~F.array_contains("seen", F.col("target"))
        now = met.select(
            "alias",
            F.when(go, F.col("further")).otherwise(F.col("target")).alias("target"),
            F.when(go, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"),
        )
    return now.select("alias", "target")


def canonical_events(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events under the final name of their source; the journal itself is never rewritten."""
    targets = final_targets(aliases).withColumnRenamed("target", "canonical")
    joined = events.join(targets, F.col("datasource_fingerprint") == F.col("alias"), "left")
    name = F.coalesce("canonical", "datasource_fingerprint").alias("datasource_fingerprint")
    return joined.select(*[name if c == "datasource_fingerprint" else F.col(c) for c in events.columns])


def in_scope(events: DataFrame, wanted: DataFrame, aliases: DataFrame | None = None, mode: str = "closure") -> DataFrame:
    """Events of the wanted sources under any of their names.

    ``closure`` takes the whole alias family; ``direct`` takes direct aliases and names that add display tokens to one
    of these.
    """
    names = wanted.select("fingerprint", F.col("fingerprint").alias("member")) if aliases is None else None
    if names is None and mode == "closure":
        names = expanded(aliases, wanted)
    elif names is None:
        direct = _edges(aliases).toDF("member", "fingerprint").join(wanted, "fingerprint", "left_semi").select("fingerprint", "member")
        names = direct.union(wanted.select("fingerprint", "fingerprint")).distinct()
    members = names.select("member").distinct()
    if mode == "closure" or aliases is None:
        return events.join(members, F.col("datasource_fingerprint") == F.col("member"), "left_semi")
    bare = F.col("datasource_fingerprint")
    events = events.withColumn("_bare", F.when(bare.contains("|"), F.substring_index(bare, "|", 1)).otherwise(bare))
    told = F.col("datasource_fingerprint") == F.col("member")
    shown = (F.col("_bare") == F.col("member")) & ~F.col("member").contains("|")
    first = events.join(members, told, "left_semi")
    second = events.join(members, told, "left_anti").join(members, shown, "left_semi")
    return first.union(second).drop("_bare")


def reconcile(journal: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """A verdict for each source of the journal: datasource_fingerprint, target, verdict.

    Verdicts: ``without_uri``, ``canonical``, ``aliased``, ``ambiguous`` or ``alias`` (an edge to ``target`` should be
    added). A database source whose table changes is ambiguous if several layers, or none and not one name, used it.
    """
    used = journal.groupBy("datasource_fingerprint").agg(
        F.countDistinct(F.nullif("layer_id_snapshot", F.lit(""))).alias("layers"),
        F.countDistinct(F.nullif("layer_name_snapshot", F.lit(""))).alias("names"),
    )
    known = registry.select("datasource_fingerprint", F.col("provider_type").alias("told"), "source_uri")
    edges = _edges(aliases).toDF("datasource_fingerprint", "now")
    back = _edges(aliases).select(F.col("alias_fingerprint").alias("target"), F.col("target_fingerprint").alias("back"))
    own = identity.provider_of("datasource_fingerprint")
    clash = (own != "") & (F.coalesce("told", F.lit("")) != "") & (F.col("told") != own)
    target = identity.source_fingerprint(F.coalesce(F.nullif("told", F.lit("")), own), "source_uri")
    no_uri = (F.coalesce("source_uri", F.lit("")) == "") | clash
    joined = used.join(known, "datasource_fingerprint", "left").join(edges, "datasource_fingerprint", "left")
    joined = joined.withColumn("target", F.when(~no_uri, target)).join(back, "target", "left")
    moved = own.isin(*identity.DATABASE_PARTS) & (identity.table_token("datasource_fingerprint") != identity.table_token("target"))
    unclear = moved & ((F.col("layers") > 1) | ((F.col("layers") == 0) & (F.col("names") != 1)))
    verdict = (
        F.when(F.col("target").isNull(), "without_uri")
        .when(F.col("target") == F.col("datasource_fingerprint"), "canonical")
        .when(F.col("now") == F.col("target"), "aliased")
        .when(F.col("now").isNotNull() | (F.col("back") == F.col("datasource_fingerprint")) | unclear, "ambiguous")
        .otherwise("alias")
    )
    return joined.select("datasource_fingerprint", "target", verdict.alias("verdict")).distinct()


def shared_fingerprints(layers: DataFrame) -> DataFrame:
    """Fingerprints that two layers or more have: datasource_fingerprint, n_layers."""
    return layers.groupBy("datasource_fingerprint").agg(F.countDistinct("layer_id_snapshot").alias("n_layers")).where("n_layers > 1")
