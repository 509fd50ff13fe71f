"""Reading the tables and staging between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.sinks import shared_folder, stage

__all__ = ["doc_fold", "labelled_sample", "shared_folder", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have no fold."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` training rows of each label value.

    The rows are those of smallest id hash, a fixed sample of the labelled rows. The
    sample's ids are joined as a broadcast: ``2 * per_class`` ids bound its size.
    Labels other than 0 and 1, and rows without an id, are left out; a document with
    contradicting labels counts as 1.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & training)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = (
            usable.filter(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
