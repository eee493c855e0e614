"""Session settings that every entry point of the library expects."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans, not the size of the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "stratalog", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the library's settings; ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode only, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="stratalog-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_settled: list[tuple[SparkSession, str]] = []
_here: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("settled_here", default=None)


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once for all their uses, and the end of a long plan.

    They are written as a table to the folder that ``shared_folder`` names, which outlives executors, and read from there,
    so later steps know its size. ``discard_settled`` deletes these tables when the results that read them are done with.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = _here.get()
    (_settled if kept is None else kept).append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settled_here() -> Iterator[None]:
    """Deletes, at its end, the tables that ``settled`` makes inside it: for work whose result is written before it ends."""
    mine: list[tuple[SparkSession, str]] = []
    token = _here.set(mine)
    try:
        yield
    finally:
        _here.reset(token)
        for session, path in mine:
            _delete(session, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_settled(spark: SparkSession) -> int:
    """Deletes the tables that ``settled`` made in this session and says how many they were."""
    mine = [path for session, path in _settled if session is spark]
    for path in mine:
        _delete(spark, path)
    _settled[:] = [x for x in _settled if x[0] is not spark]
    return len(mine)
