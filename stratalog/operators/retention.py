"""What a journal may forget: purges as new versions of the journal, and what they cost."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import moments
from stratalog.operators.scope import expanded
from stratalog.session import settled
from stratalog.sources.journal import is_active, is_trace, write_journal

RETENTION_DAYS, MOST_EVENTS = 365, 1_000_000


def retention_cutoff(now: datetime, days: int = RETENTION_DAYS) -> str:
    return (now - timedelta(days=days)).isoformat()


def older_than(journal: DataFrame, cutoff: str) -> DataFrame:
    return journal.where(F.col("created_at") < cutoff)


def purge_before(journal: DataFrame, cutoff: str) -> DataFrame:
    """The journal without events before ``cutoff``."""
    return journal.where(~F.coalesce(F.col("created_at") < cutoff, F.lit(False)))


def commit_boundary(journal: DataFrame, most: int) -> DataFrame:
    """One row, ``boundary``: the time from which events are kept so that about ``most`` are left; null to keep all.

    The cut falls between commits (events of one time). If it fell within the first commit, it moves behind it. Events
    are counted per time, times per day; days, a few thousand rows at most, are put in order, and then the times of the
    one day in which the cut falls.
    """
    commits = journal.where("created_at IS NOT NULL").groupBy("created_at").agg(F.count("*").alias("n"))
    commits = settled(commits.withColumn("day", F.substring("created_at", 1, moments.DAY_LENGTH)))
    back = lambda c: Window.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, 0)
    days = commits.groupBy("day").agg(F.sum("n").alias("n")).withColumn("kept", F.sum("n").over(back("day")))
    # The oldest event to keep lies in the day, and of that in the commit, where the count from the newest reaches ``most``.
    day = days.where(F.col("kept") >= most).agg(F.max(F.struct("day", (F.col("kept") - F.col("n")).alias("newer"))).alias("d")).select("d.*")
    inside = commits.join(F.broadcast(day), "day").withColumn("kept", F.sum("n").over(back("created_at")) + F.col("newer"))
    at = inside.where(F.col("kept") >= most).agg(F.max("created_at").alias("at"))
    whole = commits.agg(F.sum("n").alias("total"), F.min("created_at").alias("first"))
    second = commits.join(F.broadcast(whole), F.col("created_at") > F.col("first")).agg(F.min("created_at").alias("second"))
    met = whole.join(F.broadcast(at)).join(F.broadcast(second))  # one row each
    cut = F.when(F.col("at") > F.col("first"), F.col("at")).otherwise(F.col("second"))
    return met.select(F.when(F.lit(most > 0) & (F.col("total") > most), cut).alias("boundary"))


def purge_excess(journal: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """The journal cut at ``commit_boundary``."""
    bound = F.broadcast(commit_boundary(journal, most))  # one row
    return journal.join(bound).where(F.col("boundary").isNull() | (F.col("created_at") >= F.col("boundary"))).select(*journal.columns)


def pairs(journal: DataFrame) -> DataFrame:
    """(event_id, next_id): an insert and the delete next after it, of one entity and session, without invalidated events."""
    line = Window.partitionBy("entity_fingerprint", "session_id").orderBy("event_id")
    own = journal.where(is_active() & F.col("entity_fingerprint").isNotNull())
    placed = own.select("event_id", "operation_type", F.lead("operation_type").over(line).alias("next_op"), F.lead("event_id").over(line).alias("next_id"))
    return placed.where("operation_type = 'INSERT' AND next_op = 'DELETE'").select("event_id", "next_id")


def purge_pairs(journal: DataFrame, passes: int | None = None) -> DataFrame:
    """The journal without inserts and the deletes next after them, again and again until no such pair is left.

    A pair that comes together only as the one inside it goes is a pair of the next pass; ``passes`` is how many are made
    at most, 1 for the pairs of the journal as it is (those of ``pairs`` and ``garbage_counts``). Rounds run on the four columns that decide, of the entities that still have both kinds of event.
    """
    own = journal.where(is_active() & F.col("entity_fingerprint").isNotNull())
    left = own.select("entity_fingerprint", "session_id", "event_id", "operation_type", "invalidated_at")
    gone, done = None, 0
    while passes is None or done < passes:
        found = pairs(left)
        round_ = settled(found.select("event_id").union(found.select("next_id")))
        if not round_.limit(1).count():
            break
        gone = round_ if gone is None else gone.union(round_)
        done += 1
        if done != passes:
            left = settled(left.join(round_, "event_id", "left_anti"))
    return journal if gone is None else journal.join(gone, "event_id", "left_anti").select(*journal.columns)


def orphan_traces(journal: DataFrame) -> DataFrame:
    """Traces whose source is not a user event of the journal."""
    users = journal.where(~is_trace()).select(F.col("event_id").alias("restored_from_event_id"))
    return journal.where(is_trace()).join(users, "restored_from_event_id", "left_anti").select(*journal.columns)


def purge_orphan_traces(journal: DataFrame) -> DataFrame:
    users = journal.where(~is_trace()).select(F.col("event_id").alias("restored_from_event_id"))
    kept = journal.where(is_trace()).join(users, "restored_from_event_id", "left_semi").select(*journal.columns)
    return journal.where(~is_trace()).unionByName(kept)


def purge_invalidated(journal: DataFrame) -> DataFrame:
    return journal.where(is_active())


def purge_session(journal: DataFrame, session: str) -> DataFrame:
    return journal.where(~F.col("session_id").eqNullSafe(session))


def purged(journal: DataFrame, cutoff: str, most: int = MOST_EVENTS, garbage: bool = False) -> DataFrame:
    """The journal after the retention purge, the excess purge and, if asked for, that of logical garbage."""
    out = purge_excess(purge_before(journal, cutoff), most)
    return purge_orphan_traces(purge_pairs(purge_invalidated(out))) if garbage else out


def garbage_counts(journal: DataFrame) -> DataFrame:
    """One row: invalidated events, insert and delete pairs, orphan traces, and how many events these are."""
    one = journal.agg(F.count("invalidated_at").alias("n_invalidated"))
    out = one.join(F.broadcast(pairs(journal).agg(F.count("*").alias("n_pairs")))).join(F.broadcast(orphan_traces(journal).agg(F.count("*").alias("n_orphans"))))
    return out.withColumn("n_garbage", F.col("n_invalidated") + 2 * F.col("n_pairs") + F.col("n_orphans"))


def horizons(journal: DataFrame, cutoff: str, aliases: DataFrame | None = None) -> DataFrame:
    """(datasource_fingerprint, purged_until): the newest time that a purge before ``cutoff`` removes, for all names."""
    newest = older_than(journal, cutoff).groupBy("datasource_fingerprint").agg(F.max("created_at").alias("purged_until"))
    if aliases is None:
        return newest
    names = expanded(aliases, newest.select(F.col("datasource_fingerprint").alias("fingerprint")))
    met = names.join(newest, names["fingerprint"] == newest["datasource_fingerprint"])
    return met.groupBy("member").agg(F.max("purged_until").alias("purged_until")).withColumnRenamed("member", "datasource_fingerprint")


def compact(journal: DataFrame, path: str, buckets: int = 64) -> None:
    """Rewrites a journal in few files, ordered by entity and time within each, for narrow reads."""
    write_journal(journal, path, "overwrite", buckets, ordered=True)
