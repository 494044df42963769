"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets the shuffle files of a write go when it has ended; the table that was written replaces them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="atlasframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the application's own folder."""
    return f"{shared_dir(spark)}/atlasframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python workers that many rows at a time: whole texts of a batch lie in the JVM and the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    That cuts the lineage (a lost executor costs a reread, not a recomputation) and gives later joins a known size,
    so that Spark broadcasts a side only where its bytes are below spark.sql.autoBroadcastJoinThreshold. All tables of an
    application lie in one folder, named after it, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = new_path(spark)
    writer = df.write.option("compression", "zstd")
    with shuffles_end_with_writes(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more, neither directly nor as the lineage of a later result."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class BucketedTable:
    """A table in the shared folder whose rows lie in n_files parts by a column, so that grouping by it needs no shuffle."""

    def __init__(self, spark: SparkSession, column: str, n_files: int):
        path = new_path(spark)
        self.spark, self.column, self.n_files, self.path = spark, column, n_files, path
        self.name = "atlasframe_" + path.rsplit("/", 1)[1]

    def append(self, rows: DataFrame, in_parts: bool = False) -> None:
        """Add rows, each part in one file; in_parts: they lie in these parts already."""
        parts = rows if in_parts else rows.repartition(self.n_files, self.column)
        writer = parts.write.format("parquet").mode("append").option("path", self.path).option("compression", "zstd")
        with shuffles_end_with_writes(self.spark):
            writer.bucketBy(self.n_files, self.column).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Delete the table, which nothing reads any more."""
        self.spark.sql(f"DROP TABLE {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def workers_import_us(spark: SparkSession) -> None:
    """Let Python workers that start from now on find this package where it was not shipped with --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPO not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, paths]))
