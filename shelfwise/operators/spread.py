"""Rows dealt out by their number, where the work is in the rows and not in the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows in ``spark.sql.shuffle.partitions`` parts, by a hash of those columns it has.

    A catalog of few bytes comes in few input splits, whatever is then made of each row.
    Parts of a stated number are not put together again by adaptive execution.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *[c for c in columns if c in df.columns])


def held_parts(df: DataFrame) -> int:
    """In how many parts a table lies that the session holds as it is; 0 where only a job can tell."""
    plan = df._jdf.queryExecution().sparkPlan()
    return plan.execute().getNumPartitions() if plan.nodeName() == "Scan ExistingRDD" else 0
