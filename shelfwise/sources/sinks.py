"""Writing reports, and tables that other jobs read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Nested reports as parquet, ORC or JSON lines."""
    report.write.mode(mode).format(fmt).save(path)


def write_not_found(missing: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Requests without a product, written beside the report."""
    missing.write.mode(mode).format(fmt).save(path)


def write_checked(lines: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Products and rejects of ``read_catalog_lines`` in one job: folders ``outcome=accepted`` and ``=rejected``."""
    outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    lines.withColumn("outcome", outcome).write.mode(mode).partitionBy("outcome").format(fmt).save(path)


def write_resolved(resolved: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Requests with their products, and those without, in one job: a folder for each ``outcome``."""
    resolved.write.mode(mode).partitionBy("outcome").format(fmt).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="shelfwise-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage in a way that outlives executors, and gives the optimizer
    the real size of the table, by which it broadcasts it or not.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store Spark can write to; none is no error."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders below a path that a job has finished writing."""
    system, where = _file_system(spark, path)
    if not system.exists(where):
        return []
    below = [status.getPath() for status in system.listStatus(where) if status.isDirectory()]
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.toString() for p in below if system.exists(marker(p, "_SUCCESS")))


class Staging:
    """Tables kept in the shared folder for as long as a caller needs them.

    As a context manager it removes them at the end.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self.folder = f"{shared_folder(spark)}/staging-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: its size is known then, and its lineage short."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove the tables written under these names, which nothing reads any more."""
        system, where = _file_system(self._spark, self.folder)
        for status in system.listStatus(where):
            if status.getPath().getName().rpartition("-")[0] in names:
                system.delete(status.getPath(), True)

    def settle(self) -> None:
        """Let Spark remove the shuffle files of what has been written.

        It does so when the driver's garbage collector finds that nothing refers to them any
        more, which on a driver with memory to spare may be long after.
        """
        gc.collect()
        self._spark._jvm.java.lang.System.gc()

    def remove(self) -> None:
        remove_folder(self._spark, self.folder)

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()
