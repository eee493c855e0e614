"""Tables in the cluster's shared folder, and small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import shared_folder


#: Lets Spark delete a query's shuffle files as soon as the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of its own in the shared folder, for tables that cut lineage.

    Each table is written once and read back, so a lost executor costs at most the stage that reads it. Tables stay until
    ``drop``; those that a returned DataFrame reads must outlive it.
    """

    #: Workspaces not dropped as a whole yet, in order of making.
    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.opened.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if not name and self in Workspace.opened:
            Workspace.opened.remove(self)


def row_numbered(docs: DataFrame, space: Workspace, name: str = "rows") -> DataFrame:
    """``docs`` with ``_row``, a 64-bit number of each row by its file and place in it; written first if it isn't a table of files."""

    def numbered(rows: DataFrame) -> DataFrame:
        # By this call, so that a column of the table that is called _metadata too is no matter.
        place = rows.metadataColumn("_metadata")
        return rows.select("*", F.xxhash64(place["file_path"], place["row_index"]).alias("_row"))

    try:
        return numbered(docs)
    except AnalysisException:
        return numbered(space.write(docs, name))


#: Rows to be left out (some 40 bytes each) are told to the scan by broadcast up to this number; beyond, tables meet by shuffle.
BROADCAST_ROWS = 500_000


def without_rows(docs: DataFrame, gone: DataFrame, space: Workspace, name: str = "gone", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (of ``row_numbered``) without the rows that ``gone`` (doc_id, _row) lists, and without ``_row``."""
    gone = space.write(gone.select(F.col("doc_id").alias("_gone"), F.col("_row").alias("_at")), name)
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("shuffle_hash")
    same = (docs["_row"] == gone["_at"]) & docs["doc_id"].eqNullSafe(gone["_gone"])
    return docs.join(gone, same, "left_anti").drop("_row")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
