"""Exact dedup by content-defined chunk recipes, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.shared import Workspace

#: A chunk has 512 to 2048 characters and ends after a mark and white space, a place that its own content sets; text
#: without such a place is cut after 2048 characters.
CHUNK_PATTERN = r"(?s).{511,2046}?[.,;:!?\n]\s|.{1,2048}"
#: Rows of a repeated text are dealt over so many tasks when they meet their group.
SALTS = 16


def chunk_recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``text_sha256`` and ``chunks``: the ordered chunk list of each text, null counting as empty.

    A chunk is listed as its 64-bit identifier, its bytes and 60 bits of its SHA-256 as proof. Texts never leave the
    task that reads them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    proof = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col(key).alias("key"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.sha2(whole, 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all(whole, F.lit(CHUNK_PATTERN), F.lit(0)),
            lambda c: F.struct(F.xxhash64(c).alias("id"), F.octet_length(c).alias("bytes"), proof(c).alias("proof")),
        ).alias("chunks"),
    )


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """Each chunk identifier once, its uses, and ``verified``: False where chunks of different bytes or proof share it."""
    return (
        recipes.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.id").alias("id"))
        .agg(
            F.count("*").alias("uses"),
            ((F.min("c.proof") == F.max("c.proof")) & (F.min("c.bytes") == F.max("c.bytes"))).alias("verified"),
        )
    )


def recipe_groups(listed: DataFrame, keep: str = "max", by: list[str] | None = None) -> DataFrame:
    """Recipes of two rows or more: ``group_size``, ``keep_id``, and ``confirmed``: whether all have one ``text_sha256``."""
    best = F.max if keep == "max" else F.min
    return (
        listed.groupBy(*(by or ["recipe"]))
        .agg(
            F.count("*").alias("group_size"),
            best("key").alias("keep_id"),
            (F.min(listed["text_sha256"]) == F.max(listed["text_sha256"])).alias("confirmed"),
        )
        .where("group_size > 1")
    )


def exact_groups(docs: DataFrame, space: Workspace, text: str = "text", key: str = "doc_id", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their ordered lists of verified chunk identifiers are; rows are grouped by these alone, and the
    SHA-256 of the whole text checks each group afterwards (were one not confirmed, it would group rows too). Of equal texts the row with the largest key (``keep="max"``) or the smallest stays. Were an identifier to stand
    for two contents, lists would be compared with their proofs instead.

    A null text equals the empty one. Null keys lose to all others; if all keys of a group are null, all its rows stay.
    Rows that repeat the staying key are one document and stay together; each counts in ``group_size``. Extra columns are
    ignored, an empty table gives no rows.

    Plan: texts are read once and only their recipes (some 40 bytes per kilobyte) move. Groups are counted with map-side
    combine; rows of repeated texts meet their group over ``SALTS`` tasks each, so one text may hold a third of all rows.
    """
    recipes = space.write(chunk_recipes(docs, text, key), "recipes")
    shared = chunk_dictionary(recipes).where("NOT verified").limit(1).count() > 0
    brief = F.transform("chunks", lambda c: c if shared else F.struct(c["id"].alias("id")))
    listed = recipes.select("key", "text_sha256", brief.alias("recipe"))
    groups = space.write(recipe_groups(listed, keep), "groups")
    on = ["recipe"]
    if groups.where("NOT confirmed").limit(1).count():
        on = ["recipe", "text_sha256"]
        groups = recipe_groups(listed, keep, on)
    groups = groups.drop("confirmed").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = listed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    # By sorting: the salted groups are larger than their files tell, too large to be told to all by the driver.
    return rows.join(groups.hint("merge"), [*on, "salt"], "left").select(
        F.col("key").alias(key),
        F.coalesce("keep_id", "key").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("key").eqNullSafe(F.coalesce("keep_id", "key")).alias("kept"),
        "text_sha256",
    )
