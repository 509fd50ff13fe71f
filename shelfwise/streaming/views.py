"""The product each viewer looked at last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.functions.urls import page_barcode
from shelfwise.sources.snapshots import KEEP_VERSIONS, Conflict, FolderTable

#: Of a table without any batch.
LATEST_SCHEMA = "user_id long, ts timestamp, event_id long, barcode string"


def product_views(views: DataFrame) -> DataFrame:
    """Page views (user_id, event_id, ts, url) of product pages, with the barcode."""
    return views.withColumn("barcode", page_barcode(F.col("url"))).filter(
        F.col("barcode").isNotNull()
    )


def latest_viewed(views: DataFrame) -> DataFrame:
    """(user_id, ts, event_id, barcode) of each viewer's last product page.

    Works on a table and on a stream. A viewer with very many views is reduced
    to one row per input task before the shuffle.
    """
    return _latest(product_views(views))


def _latest(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("ts", "event_id", "barcode")).alias("last")
    return rows.groupBy("user_id").agg(last).select("user_id", "last.*")


def start_latest_viewed(
    views: DataFrame,
    path: str,
    checkpoint: str,
    compact_every: int = 50,
    keep_versions: int = KEEP_VERSIONS,
    **trigger,
) -> StreamingQuery:
    """Keep a table of last viewed products up to date from a stream.

    Each micro-batch writes the last views in it to a new folder and commits that. The
    query keeps no state of its own, and any number of queries may feed one table. Every
    ``compact_every`` batches the folders become one. Taking the latest is the same however
    often a row is there, so a batch that is tried again does no harm. Folders that have been
    put together stay for ``keep_versions`` more commits, for readers that have planned on them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = FolderTable(spark, path)
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.commit([table.write(_latest(batch), f"{query}-{batch_id:09d}")])
        if (batch_id + 1) % compact_every == 0:
            compact_latest_viewed(spark, path)
            table.clean(keep_versions)

    return (
        product_views(views)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact_latest_viewed(spark: SparkSession, path: str) -> bool:
    """Put the folders of a table together in one; False if another writer did so first.

    The folders that were merged are replaced in one commit, and folders committed meanwhile
    stay. If any of the merged ones has been replaced already, this merge is thrown away.
    """
    table = FolderTable(spark, path)
    _, folders = table.state()
    if len(folders) < 2:
        return False
    merged = table.write(_latest(table.rows_of(folders)), "merged")
    try:
        table.commit([merged], folders)
    except Conflict:
        table.discard(merged)
        return False
    return True


def read_latest_viewed(spark: SparkSession, path: str) -> DataFrame:
    """Current state of the table; empty before the first batch."""
    rows = FolderTable(spark, path).read()
    return spark.createDataFrame([], LATEST_SCHEMA) if rows is None else _latest(rows)
