"""First rows of each group, safe for groups that hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, shards: int, rank: str
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in column ``rank``.

    Two steps: the first ``k`` of each (group, shard), then of each group. A row
    among the first ``k`` of its group is among the first ``k`` of any part of
    it, so the result does not depend on how rows fall into shards. The shard is
    that of the input partition: each input task still sends at most ``k`` rows
    per group (Spark cuts before the shuffle), and the last step sees at most
    ``k * shards`` rows of any group, however large the group is.
    """
    shard = "_shard"
    in_shard = Window.partitionBy(*keys, shard).orderBy(*order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(shard, F.pmod(F.spark_partition_id(), F.lit(shards)))
        .withColumn(rank, F.row_number().over(in_shard))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(in_group))
        .filter(F.col(rank) <= k)
        .drop(shard)
    )
