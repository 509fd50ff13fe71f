"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage
from shelfwise.sources.sinks import Staging


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other that hangs below none."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below")),
    )
    nodes = (
        edges.select(F.explode(ends).alias("e"))
        .groupBy("e.node")
        .agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
    )
    return nodes.filter((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("least") == 0))).isEmpty()


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of a node and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def components(
    edges: DataFrame, u: str = "a", v: str = "b", max_rounds: int = 60, work: Staging | None = None
) -> DataFrame:
    """(node, component): for every node of an undirected edge table its component's smallest node.

    Alternates large-star and small-star steps, which hang every node below ever
    smaller neighbours until only stars remain; the number of rounds is logarithmic in
    the number of nodes. Edges stay in distributed tables, each round is written to the
    shared folder, and a hub is only ever aggregated or joined, never gathered.
    Loops and null ends are ignored; an empty table gives an empty result. With ``work`` the
    rounds are kept in that staging, which its owner removes, and the driver is settled after each.
    """
    store = stage if work is None else work.table
    usable = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    edges = usable.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = store(edges.distinct(), "components")
    for _ in range(max_rounds):
        if _only_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(_nearest(both), "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        # read three times below, where each would bring the whole step above into the plan
        large = store(large, "components")
        parents = _nearest(large)
        small = (
            large.join(parents, "u")
            .filter(F.col("v") != F.col("least"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .union(parents.select("u", F.col("least").alias("v")))
            .distinct()
        )
        edges = store(small, "components")
        if work is not None:
            work.settle()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
