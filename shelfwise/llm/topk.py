"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows; a dimension is a term. Candidates and queries are
packed into blocks of posting lists by term. For a pair of blocks each term's weighted
postings are scattered into a dense array of scores (queries x candidates), and the k
best of each query are selected by partition; the best of all blocks are merged at the
end. Every query meets every candidate, so the work is the product of the two sizes by
nature; it is dealt out as a grid of block pairs, of which no task holds more than one
at a time, and each pair gives at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage

CANDIDATE_ROWS = 4096
QUERY_ROWS = 1024
TILE = 64
#: Query blocks in one column of the grid.
COLUMN_BLOCKS = 16

#: What a block's weights are kept as: the first of these that holds them all.
WEIGHT_KINDS = (np.int16, np.int32, np.int64)

BLOCK_SCHEMA = "block long, ids binary, terms binary, counts binary, rows binary, weights binary"
PART_SCHEMA = "query_key string, query_id long, vec_id long, score long"

Batches = Iterator[pa.RecordBatch]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component, for rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"),
    )


def _narrowed(weights: np.ndarray) -> np.ndarray:
    """The weights in the narrowest kind that holds them and their negatives."""
    low, high = int(weights.min(initial=0)), int(weights.max(initial=0))
    fits = (k for k in WEIGHT_KINDS if -np.iinfo(k).max <= low and high <= np.iinfo(k).max)
    return weights.astype(next(fits, np.int64))


def _blocks(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                weights = lists.flatten().to_numpy()
                rows = np.repeat(np.arange(len(lengths)), lengths)
                begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                terms = np.arange(len(weights)) - np.repeat(begins, lengths)
                live = np.flatnonzero(weights)
                live = live[np.argsort(terms[live], kind="stable")]
                found, counts = np.unique(terms[live], return_counts=True)
                arrays = (found.astype(np.int32), counts.astype(np.int32), rows[live].astype(np.int32), _narrowed(weights[live]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()),
                        *(pa.array([a.tobytes()], pa.binary()) for a in arrays),
                    ],
                    names=["block", "ids", "terms", "counts", "rows", "weights"],
                )
                number += 1

    return run


class Postings:
    """A block's posting lists."""

    def __init__(self, ids: bytes, terms: bytes, counts: bytes, rows: bytes, weights: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.rows = np.frombuffer(rows, np.int32)
        self.weights = np.frombuffer(weights, f"i{len(weights) // max(len(self.rows), 1) or 8}")
        ends = np.cumsum(np.frombuffer(counts, np.int32))
        self.lists = {
            int(t): slice(int(a), int(b))
            for t, a, b in zip(np.frombuffer(terms, np.int32), np.concatenate(([0], ends[:-1])), ends)
        }
        self.largest = int(np.abs(self.weights).max(initial=0))

    def tiles(self, size: int) -> Iterator[tuple[int, "dict[int, tuple[np.ndarray, np.ndarray]]"]]:
        """Posting lists of ``size`` rows at a time."""
        for first in range(0, len(self.ids), size):
            part = {}
            for term, where in self.lists.items():
                rows = self.rows[where]
                a, b = np.searchsorted(rows, (first, first + size))
                if a < b:
                    part[term] = rows[a:b] - first, self.weights[where][a:b]
            yield first, part


def _filled(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The weights of all ``n`` rows: zero for those a list does not have."""
    out = np.zeros(n, dtype=weights.dtype)
    out[rows] = weights
    return out


def accumulated(tile: dict, n_queries: int, candidates: Postings, kind: type) -> np.ndarray:
    """Scores of a tile of queries against a block, one term after the other."""
    n = len(candidates.ids)
    scores = np.zeros((n_queries, n), dtype=kind)
    scratch = np.empty_like(scores)
    for term, (queries, query_weights) in tile.items():
        where = candidates.lists.get(term)
        if where is None:
            continue
        rows, weights = candidates.rows[where], candidates.weights[where].astype(kind)
        query_weights = query_weights.astype(kind)
        # A list of most rows is filled up: adding to all rows is many times faster than to some.
        if 2 * len(rows) >= n and 2 * len(queries) >= n_queries:
            filled = _filled(queries, query_weights, n_queries)
            np.multiply.outer(filled, _filled(rows, weights, n), out=scratch)
            scores += scratch
        elif 2 * len(rows) >= n:
            scores[queries] += np.multiply.outer(query_weights, _filled(rows, weights, n))
        else:
            scores[np.ix_(queries, rows)] += np.multiply.outer(query_weights, weights)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores of other rows; ties go to smaller ids."""
    others = np.flatnonzero(ids != own)
    if len(others) > k:
        values = scores[others]
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = others[values > least]
        equal = others[values == least]
        equal = equal[np.argsort(ids[equal], kind="stable")][: k - len(above)]
        others = np.concatenate((above, equal))
    return others


def _pair_batches(k: int) -> Callable[[Batches], Batches]:
    fields = ("ids", "terms", "counts", "rows", "weights")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                queries = Postings(*(value(f"q_{f}") for f in fields))
                candidates = Postings(*(value(f"c_{f}") for f in fields))
                terms = min(len(queries.lists), len(candidates.lists))
                small = queries.largest * candidates.largest * max(terms, 1) < 1 << 31
                out = []
                for first, tile in queries.tiles(TILE):
                    ids = queries.ids[first : first + TILE]
                    scores = accumulated(tile, len(ids), candidates, np.int32 if small else np.int64)
                    for at, query in enumerate(ids.tolist()):
                        key = f"{value('q_block')}:{first + at}"
                        for c in best(scores[at], candidates.ids, query, k).tolist():
                            out.append((key, query, int(candidates.ids[c]), int(scores[at, c])))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)],
                    names=["query_key", "query_id", "vec_id", "score"],
                )

    return run


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query row.

    Components are quantised to floor(scale * x); the score is the integer inner product
    over the dimensions both vectors have. Ties go to the smaller id; a query never finds
    rows with its own id, and has fewer than k results only if there are fewer other rows.

    Vectors that are null or hold null, NaN or infinite components, and rows without an
    id, take no part; empty vectors score 0 with every row. Query rows that share an id
    are answered row by row; repeated candidates are results of their own. Scores must
    fit into a long. Other columns play no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    candidates = stage(rows.mapInArrow(_blocks(CANDIDATE_ROWS), BLOCK_SCHEMA), "candidates")
    queries = stage(
        rows.filter(is_query).mapInArrow(_blocks(QUERY_ROWS), BLOCK_SCHEMA),
        "queries",
    )
    columns = max(1, -(-queries.count() // COLUMN_BLOCKS))
    lines = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), candidates.count()))
    left = queries.select(
        *(F.col(c).alias(f"q_{c}") for c in queries.columns),
        F.pmod(F.xxhash64("block"), F.lit(columns)).alias("column"),
        _each(lines).alias("line"),
    )
    right = candidates.select(
        *(F.col(c).alias(f"c_{c}") for c in candidates.columns),
        _each(columns).alias("column"),
        F.pmod(F.xxhash64("block"), F.lit(lines)).alias("line"),
    )
    # Catalyst sizes both sides as if they were not copied: of its own accord it would broadcast
    # the queries with a copy for every line, which no driver holds. Parts of a stated number
    # are not put together again, for the work is in the pairs and not in the bytes.
    cell = ["column", "line"]
    left, right = (side.repartition(lines * columns, *cell) for side in (left, right))
    pairs = left.join(right.hint("merge"), cell)
    found = pairs.mapInArrow(_pair_batches(k), PART_SCHEMA)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
