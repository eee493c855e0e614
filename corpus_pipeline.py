"""A training-corpus pipeline: five operators of the library, each working on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.decontam import contamination
from stratalog.llm.exact import exact_groups
from stratalog.llm.jaccard import similar_groups
from stratalog.llm.mixing import mix_sources
from stratalog.llm.ordinal import ADDED, fit_on_labels, grade_documents, select_documents
from stratalog.llm.shared import Workspace, read_table, row_numbered, without_rows


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its own columns of ``names`` renamed, and what gives a result their names and ``docs``'s columns back."""
    away = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(away), lambda df: df.drop(*away).withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)


#: Names that the duplicate stages give to columns of their own.
ROW_NAMES = ["_row", "_metadata", "_gone", "_at"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; the fit uses the labelled ones among ``docs``.

    Where none of them is labelled there is nothing to judge by, and all stay. Every row is judged on its own text: null
    and empty texts as texts without words, repeated rows alike, null ids too. Columns pass as they are.
    """
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    own, back = set_aside(docs, [*ADDED, "keep"])
    return back(select_documents(grade_documents(own, model)).where("keep"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id; a null id counts as smallest, null texts as empty.

    The decision falls on rows, not on ids: rows of one id with different texts are judged apart, and of rows that are
    the same in id and text one stays. Columns pass as they are; an empty table stays empty.
    """
    space = Workspace(spark, "pipeline-exact")
    own, back = set_aside(docs, ROW_NAMES)
    rows = row_numbered(own, space)
    keyed = rows.select(F.struct("doc_id", "_row").alias("key"), "text")
    gone = exact_groups(keyed, space, key="key").where("NOT kept").select("key.doc_id", "key._row")
    return back(without_rows(rows, gone, space))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id.

    A null id counts as largest. The decision falls on rows, as in ``exact_dedup``; rows without words all stay. Columns
    pass as they are; an empty table stays empty.
    """
    space = Workspace(spark, "pipeline-near")
    own, back = set_aside(docs, ROW_NAMES)
    rows = row_numbered(own, space)
    groups = similar_groups(rows.select("doc_id", "text", "_row"), space, words=5, percent=80, tie="_row")
    gone = groups.where("NOT kept").select("doc_id", F.col("tie").alias("_row"))
    return back(without_rows(rows, gone, space))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a ten-word window of a benchmark item (a shorter item counts whole).

    Null and empty texts and all rows under an empty benchmark stay; repeated rows are judged alike; columns pass as they
    are.
    """
    own, back = set_aside(docs, ["n_words", "hit_spans", "hit_items"])
    return back(contamination(own, read_table(spark, sf_dir, "benchmark")).where(F.size("hit_spans") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row: doc_id, source, size, source_size, target, taken.

    Null and empty texts give no words, a null source is a source of its own, repeated rows are mixed each on its own.
    """
    mixed = mix_sources(docs, Workspace(spark, "pipeline-mix"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]
#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next.

    When a stage is written, its own tables and its predecessor's output are deleted.
    """
    docs = read_table(spark, sf_dir, "documents")
    space, before = Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        mark = len(Workspace.opened)
        docs = space.write(stage(spark, docs, sf_dir), name)
        for used in Workspace.opened[mark:]:
            used.drop()
        if before:
            space.drop(before)
        before = name
    return docs
