"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: A shard has about so many documents, and its budget is cut into so many equal blocks of tokens.
SHARD_DOCS, SHARD_BLOCKS = 2048, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target``: ``budget`` times all sizes, shared by weight, capped at ``most`` sizes.

    Sources in code-point order (null last) take the weights in turn. The excess over a cap is shared again by weight
    among the rest until no source is above its cap: with sources in order of cap by weight, the capped ones are a prefix,
    and one running sum finds where it ends. The table has a row for each source, never for documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("whole") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("open_level", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("place"))).over(everything))
    )
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("open_level"), "cap"))
    return per.select("source", "source_size", target.alias("target"))


def block_quotas(strata: DataFrame, blocks: int) -> DataFrame:
    """Adds ``quota`` to rows (shard, source, part): Sainte-Lague seats among ``blocks`` equal blocks of each shard.

    The quotients are part/1, part/3, part/5, ...; the highest ``blocks`` of a shard win. A source can't win more than
    its share of blocks times 1 + sources / (2 blocks), plus one, so no more quotients than that are made.
    """
    whole = Window.partitionBy("shard")
    share = F.col("part") / F.sum("part").over(whole) * blocks
    bound = F.ceil(share * (1 + F.count("*").over(whole) / F.lit(2.0 * blocks))) + 1
    quotients = (
        strata.where("part > 0")
        .withColumn("bound", bound)
        .withColumn("seat", F.explode(F.sequence(F.lit(1), F.col("bound").cast("int"))))
        .withColumn("quotient", F.col("part") / (2 * F.col("seat") - 1))
    )
    best = Window.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "seat")
    return (
        quotients.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= blocks)
        .groupBy("shard", "source")
        .agg(F.count("*").alias("quota"))
    )


def balance(quotas: DataFrame) -> DataFrame:
    """Corrects ``tokens`` of rows (s, of, target, most_tokens, tokens) so that they sum to each source's target.

    What the shards' deals left over of a source is shared among its shards by the room that they still have up to
    ``most_tokens``; what they took too much is taken back by what they took. Running sums over the source's shards in
    order are rounded, so the remainder is carried on and nothing is lost, however small a source's part in a shard is.
    """
    source = Window.partitionBy("of")
    upto = source.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    left = F.least(F.floor(F.col("target") + 0.5), F.sum("most_tokens").over(source)) - F.sum("tokens").over(source)
    room = F.when(F.col("left") > 0, F.col("most_tokens") - F.col("tokens")).otherwise(F.col("tokens"))
    shared = lambda until: F.floor(F.col("left") * (until / F.col("rooms")) + 0.5)
    change = F.when(F.col("rooms") > 0, shared(F.col("until")) - shared(F.col("until") - F.col("room"))).otherwise(0)
    return (
        quotas.withColumn("left", left)
        .withColumn("room", room)
        .withColumn("rooms", F.sum("room").over(source))
        .withColumn("until", F.sum("room").over(upto))
        .withColumn("tokens", F.greatest(F.lit(0), F.least("most_tokens", F.col("tokens") + change)).cast("long"))
        .drop("left", "room", "rooms", "until")
    )


def seeded(key: str, seed: int) -> Column:
    """A digest of an id and a seed, to deal and to order by; any engine can make it again."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def mix_sources(
    docs: DataFrame,
    space: Workspace,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``size`` is the words of the whole text (null: 0). Documents are dealt into shards by a seeded hash of their id; the
    budget of a shard is cut into equal blocks of tokens, which Sainte-Lague deals to its sources in proportion to their
    targets there. What a source's deals leave over or take too much against its target over the whole table is balanced
    between its shards (``balance``), so each source gets its target to the token. A source's documents in a shard stand in a seeded order as one line of tokens; its quota of blocks is
    taken from the line's start, going round again when it ends, so each document gives at most ``most`` times its size.

    A text of any length is counted whole. A null source is a source of its own, in last place. Empty texts give 0. Rows that repeat an id are taken each on its
    own. Reruns agree, as order and shards come from hashes of ids. Extra columns are ignored; an empty table gives none.

    Plan: texts are read once to a narrow table. Windows run over one source in one shard, some hundreds of rows however
    large a source is; quotients are at most two a document. To balance, a source has one narrow row for each shard, some
    two-thousandth of its documents.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = space.write(docs.select("doc_id", "source", size.alias("size")), "sizes")
    shards = max(1, round(sizes.count() / SHARD_DOCS))
    targets = space.write(source_targets(sizes, weights, budget, most), "targets")
    # A null source must meet itself in joins.
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    number = F.conv(F.substring(seeded("doc_id", seed), 1, 8), 16, 10).cast("long")
    dealt = sizes.withColumn("shard", F.pmod(number, F.lit(shards)).cast("int"))
    strata = dealt.groupBy("shard", "source").agg(F.sum("size").alias("stratum"))
    t = targets.withColumnRenamed("source", "of")
    strata = (
        strata.join(t, strata["source"].eqNullSafe(t["of"]))
        .drop("of")
        .withColumn("part", F.when(F.col("source_size") > 0, F.col("target") * F.col("stratum") / F.col("source_size")).otherwise(0.0))
    )
    strata = space.write(strata, "strata")
    won = block_quotas(strata, SHARD_BLOCKS).select(F.col("shard").alias("s"), F.col("source").alias("of"), "quota")
    block = F.sum("part").over(Window.partitionBy("shard")) / SHARD_BLOCKS
    quotas = (
        strata.withColumn("block", block)
        .join(won, (F.col("shard") == F.col("s")) & F.col("source").eqNullSafe(F.col("of")), "left")
        .select(
            F.col("shard").alias("s"),
            F.col("source").alias("of"),
            "source_size",
            "target",
            "stratum",
            F.floor(F.coalesce("quota", F.lit(0)) * F.col("block") + 0.5).cast("long").alias("dealt"),
            F.floor(F.col("stratum") * F.lit(float(most))).cast("long").alias("most_tokens"),
        )
        .withColumn("tokens", F.least("dealt", "most_tokens"))
    )
    quotas = balance(quotas)
    line = Window.partitionBy("shard", "source").orderBy(seeded("doc_id", seed + 1), "doc_id", "size")
    placed = dealt.withColumn("until", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(quotas, (F.col("shard") == F.col("s")) & F.col("source").eqNullSafe(F.col("of")))
    rounds = F.when(F.col("stratum") > 0, F.floor(F.col("tokens") / F.col("stratum"))).otherwise(0).cast("long")
    rest = F.col("tokens") - rounds * F.col("stratum")
    over = F.greatest(F.lit(0), F.least("size", rest - (F.col("until") - F.col("size"))))
    return joined.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (rounds * F.col("size") + over).cast("long").alias("taken"),
    )
