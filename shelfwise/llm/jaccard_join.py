"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Every set of shingles is read in one global order, rare shingles first. Two sets whose
overlap reaches ``need = ceil(percent * n / 100)`` of the larger one share a shingle among the
first ``n - need + 1`` of each, its prefix; so sets meet in the buckets of prefix shingles.
Rarity is taken from counts over all documents, kept in ``SKETCH`` counters: the order only has
to be the same everywhere for the join to be exact, and shingles that share a counter with a
frequent one merely come later.

A pair that meets at its first common shingle, at places i and j, passes if it can still reach
the overlap it needs:

* by length: the smaller set is large enough;
* by position: 1 + min(n_a - i, n_b - j) suffices;
* by suffix: 1 + the sum over ``CELLS`` cells of hash values of the smaller number of shingles
  that either set has left there suffices.

Out of a pair of blocks of a bucket come the rows that have such a partner, never pairs. Only
they are met again with their full sets, in blocks of bounded size, where a pair counts in the
bucket of its first common shingle alone. Out of it come a forest of links, which is what
components need, and the number of links of every set, which is exact.

Equal sets form a class first, of which one text goes on. Work in a bucket is quadratic in the
different sets that meet there, as their links are counted; what is written or shuffled is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.key_bits import key_bits, may_hold
from shelfwise.llm.near_dups import common_counts, shingle_runs
from shelfwise.llm.tables import stage
from shelfwise.llm.textscan import chunks, words
from shelfwise.sources.sinks import Staging

#: Counters of the rarity of shingles, and how many make a row on their way.
SKETCH_BITS, BLOCK_BITS = 20, 12
SKETCH = 1 << SKETCH_BITS
#: Cells of the suffix filter, by the first bits of a shingle's hash.
CELL_BITS = 4
CELLS = 1 << CELL_BITS
#: Earlier shared shingles that a posting carries, to see that a pair has met before.
EARLIER = 24
#: Postings of a block, pairs looked at together, and shingles of a block of full sets.
POSTING_BLOCK = 512
PAIRS_AT_ONCE = 1 << 15
SET_BLOCK = 1 << 15

_SETS = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, prefix array<long>, cells array<int>"
#: Of a posting the last two are runs of 64-bit and 32-bit numbers as bytes, which travel as one value each.
_POSTINGS = "gram long, cls long, n long, pos long, n_blocks long, earlier binary, cells binary"
_BLOCKS = "gram long, n_blocks long, block long, cls array<long>, shingles binary"
_FULL_SETS = "cls long, buckets array<struct<gram:long,n_blocks:long>>, shingles array<long>"
_PAYLOAD = ["cls", "n", "pos", "earlier", "cells"]

Batches = Iterator[pa.RecordBatch]


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with any set that is similar to one of ``n``."""
    return -(-percent * n // 100)


def _counted(size: int) -> Callable[[Batches], Batches]:
    """Counts of the shingles of a partition's texts, in rows of counters."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                shingles, _ = shingle_runs(words(chunk), size)
                counts += np.bincount((shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array([b.tobytes() for b in blocks[at]], pa.binary())], names=["block", "counts"]
        )

    return run


def _ranked(batches: Batches) -> Batches:
    """Counters summed over all partitions, as ranks: four steps for every doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(counts.as_buffer(), dtype=np.int64)
            total[block] = total[block] + values if block in total else values
    ranks = [np.floor(4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["block", "ranks"]
    )


def rarity(documents: DataFrame, shingle_words: int) -> np.ndarray:
    """The rank of every counter by the number of its shingles in all texts: ``SKETCH`` bytes."""
    counted = documents.select(F.col("text").cast("string")).mapInArrow(_counted(shingle_words), "block int, counts binary")
    rows = counted.repartition("block").mapInArrow(_ranked, "block int, ranks binary").collect()
    out = np.zeros((SKETCH >> BLOCK_BITS, 1 << BLOCK_BITS), dtype=np.uint8)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["ranks"], dtype=np.uint8)
    return out.reshape(-1)


def _rank(ranks: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return ranks[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _set_batches(size: int, percent: int, ranks: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        order = ranks.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                shingles, offsets = shingle_runs(words(chunk), size)
                rows = len(chunk.offsets) - 1
                sizes, prints = np.zeros(rows, dtype=np.int64), np.zeros((rows, 2), dtype=np.int64)
                prefixes, cells = [], np.zeros((rows, CELLS), dtype=np.int32)
                for row in range(rows):
                    own = np.unique(shingles[offsets[row] : offsets[row + 1]])
                    sizes[row] = len(own)
                    prints[row] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    rank = _rank(order, own)
                    n_prefix = len(own) - needed(len(own), percent) + 1 if len(own) else 0
                    prefixes.append(own[np.argsort(rank, kind="stable")[:n_prefix]].view(np.int64))
                    cells[row] = np.bincount(_cells(own), minlength=CELLS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, rows),
                        batch.column(1).slice(chunk.first, rows),
                        pa.array(sizes),
                        pa.array(prints[:, 0].copy()),
                        pa.array(prints[:, 1].copy()),
                        _lists(prefixes, pa.int64()),
                        _lists(list(cells), pa.int32()),
                    ],
                    names=[f.split()[0] for f in _SETS.split(", ")],
                )

    return run


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs of the given lengths."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and how many each row has; null has none."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts


def _as_bytes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of values as binary values."""
    offsets = np.concatenate(([0], np.cumsum(counts) * values.itemsize)).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), data])


def _of_bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values one after the other, and how many each has."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return held.view(kind), np.diff(offsets).astype(np.int64) // size


def _posting_batches(batches: Batches) -> Batches:
    """Postings of the shared prefix shingles of classes, with what the filters need of them.

    That are the shared shingles before it, ``EARLIER`` at most, and how many shingles the set
    has behind it in each cell.
    """
    for batch in batches:
        grams, counts = _flat(batch.column("grams"))
        places, _ = _flat(batch.column("places"))
        prefix, lengths = _flat(batch.column("prefix"))
        cells = _flat(batch.column("cells"))[0].reshape(-1, CELLS).astype(np.int64)
        of_class, k = np.repeat(np.arange(batch.num_rows), counts), _places(counts)
        marks = np.zeros((len(prefix) + 1, CELLS), dtype=np.int64)
        marks[np.arange(1, len(prefix) + 1), _cells(prefix.view(np.uint64))] = 1
        passed = np.cumsum(marks, axis=0)
        begin = (np.cumsum(lengths) - lengths)[of_class]
        left = cells[of_class] - (passed[begin + places] - passed[begin])
        n_earlier = np.minimum(k, EARLIER)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        earlier = grams[np.repeat(first, n_earlier) + _places(n_earlier)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(grams),
                batch.column("cls").take(pa.array(of_class)),
                batch.column("n").take(pa.array(of_class)),
                pa.array(places),
                pa.array(_flat(batch.column("n_blocks"))[0]),
                _as_bytes(earlier, n_earlier),
                _as_bytes(left.astype(np.int32).reshape(-1), np.full(len(left), CELLS)),
            ],
            names=["gram", "cls", "n", "pos", "n_blocks", "earlier", "cells"],
        )


def _block_pairs(rows: DataFrame, payload: list[str], work: Staging) -> DataFrame:
    """Rows (gram, n_blocks) with a payload in blocks, each paired with itself and the others of its shingle.

    Most shingles are one block, which is put together once and not stored. The rows of the others
    are dealt out by class, so no group grows with the bucket.
    """
    whole = _blocked(rows.filter(F.col("n_blocks") == 1), payload)
    several = work.table(_blocked(rows.filter(F.col("n_blocks") > 1), payload), "blocks")
    work.settle()
    return _by_itself(whole, payload).union(_paired(several, payload))


def _by_itself(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """Blocks that meet themselves: the columns of the second block end in ``_y`` and are null."""
    nothing = [F.lit(None).cast(blocks.schema[c].dataType).alias(f"{c}_y") for c in payload]
    return blocks.select("gram", *payload, *nothing)


def _paired(blocks: DataFrame, payload: list[str]) -> DataFrame:
    """All blocks by themselves, and pairs of those that share their shingle."""
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.block") < F.col("y.block"))).select(
        "x.gram", *(F.col(f"x.{c}").alias(c) for c in payload), *(F.col(f"y.{c}").alias(f"{c}_y") for c in payload)
    )
    return _by_itself(blocks, payload).union(met)


def _blocked(rows: DataFrame, payload: list[str]) -> DataFrame:
    block = F.pmod(F.xxhash64("cls"), F.col("n_blocks")).alias("block")
    grouped = rows.groupBy("gram", "n_blocks", block).agg(F.collect_list(F.struct(*payload)).alias("rows"))
    return grouped.select("gram", "n_blocks", "block", *(F.col(f"rows.{c}").alias(c) for c in payload))


class _Side(NamedTuple):
    """The postings of blocks one after the other; ``starts`` has each block's first."""

    cls: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    earlier: np.ndarray
    cells: np.ndarray
    starts: np.ndarray


def _side(batch: pa.RecordBatch, suffix: str) -> _Side:
    flat = {name: _flat(batch.column(name + suffix)) for name in ("cls", "n", "pos")}
    counts = flat["cls"][1]
    values, n_values = _of_bytes(batch.column("earlier" + suffix).flatten(), np.int64)
    earlier = np.zeros((len(n_values), EARLIER), dtype=np.int64)
    earlier[np.repeat(np.arange(len(n_values)), n_values), _places(n_values)] = values
    cells = _of_bytes(batch.column("cells" + suffix).flatten(), np.int32)[0].reshape(-1, CELLS)
    return _Side(*(flat[name][0] for name in ("cls", "n", "pos")), earlier, cells, np.concatenate(([0], np.cumsum(counts))))


def _passing(x: _Side, y: _Side, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a of x, b of y) may be similar and have not met at an earlier shingle."""
    n_a, n_b = x.n[a], y.n[b]
    need = -(-percent * (n_a + n_b) // (100 + percent))
    keep = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
    keep &= 1 + np.minimum(n_a - x.pos[a], n_b - y.pos[b]) >= need
    at = np.flatnonzero(keep)
    at = at[1 + np.minimum(x.cells[a[at]], y.cells[b[at]]).sum(axis=1) >= need[at]]
    before = x.earlier[a[at]][:, :, None]
    return at[~((before == y.earlier[b[at]][:, None, :]) & (before != 0)).any(axis=(1, 2))]


def _partner_batches(percent: int) -> Callable[[Batches], Batches]:
    """The postings of block pairs that have a partner behind all filters."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            itself = batch.column("cls_y").is_null().to_numpy(zero_copy_only=False)
            x, y = _side(batch, ""), _side(batch, "_y")
            found = [np.empty((0, 2), dtype=np.int64)]

            def look(other: _Side, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
                held, waiting = 0, []
                for part in pairs:
                    waiting.append(part)
                    held += len(part[0])
                    if held >= PAIRS_AT_ONCE:
                        look_at(other, waiting)
                        held, waiting = 0, []
                if held:
                    look_at(other, waiting)

            def look_at(other: _Side, waiting: list) -> None:
                a, b, row = (np.concatenate(c) for c in zip(*waiting))
                for first in range(0, len(a), PAIRS_AT_ONCE):
                    part = slice(first, first + PAIRS_AT_ONCE)
                    at = first + _passing(x, other, a[part], b[part], percent)
                    ends = np.concatenate((x.cls[a[at]], other.cls[b[at]]))
                    found.append(np.unique(np.stack((np.tile(grams[row[at]], 2), ends), axis=1), axis=0))

            sizes = np.diff(x.starts)
            two = np.flatnonzero(itself & (sizes == 2))
            more = np.flatnonzero(itself & (sizes > 2))
            look(x, iter([(x.starts[two], x.starts[two] + 1, two)]) if len(two) else iter(()))
            look(x, (tuple(c + x.starts[k] for c in np.triu_indices(sizes[k], 1)) + (np.full(sizes[k] * (sizes[k] - 1) // 2, k),) for k in more))
            met = np.flatnonzero(~itself)
            of = lambda side, k: np.arange(side.starts[k], side.starts[k + 1])
            look(y, (
                (np.repeat(of(x, k), len(of(y, k))), np.tile(of(y, k), len(of(x, k))), np.full(len(of(x, k)) * len(of(y, k)), k))
                for k in met
            ))
            rows = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["gram", "cls"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links (a, b) to connect what all of them connect."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while above.get(node, node) != node:
            above[node] = above.get(above[node], above[node])
            node = above[node]
        return node

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        s, t = top(u), top(v)
        if s != t:
            above[max(s, t)] = min(s, t)
            out.append((u, v))
    return out


def _packed(sets: list[np.ndarray]) -> bytes:
    """Sets that meet in a block share most shingles: each shingle once, and short numbers that refer to it."""
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    head = np.array([len(sets), len(known), *(len(s) for s in sets)], dtype=np.int64)
    return head.tobytes() + known.tobytes() + codes.astype(_code_kind(len(known))).tobytes()


def _unpacked(block: pa.Buffer) -> list[np.ndarray]:
    n_sets, n_known = np.frombuffer(block, np.int64, 2)
    sizes = np.frombuffer(block, np.int64, n_sets, 16)
    known = np.frombuffer(block, np.uint64, n_known, 16 + 8 * n_sets)
    codes = np.frombuffer(block, _code_kind(n_known), -1, 16 + 8 * (n_sets + n_known))
    return np.split(known[codes], np.cumsum(sizes)[:-1])


def _code_kind(n_known: int) -> type:
    return np.uint16 if n_known <= 1 << 16 else np.uint32


def _packed_batches(batches: Batches) -> Batches:
    """Blocks of full sets with the sets of each as one value."""
    for batch in batches:
        at, packed = batch.schema.get_field_index("shingles"), []
        for lists in batch.column(at):
            values, ends = lists.values.values.to_numpy().view(np.uint64), lists.values.offsets.to_numpy()
            packed.append(_packed([values[i:j] for i, j in zip(ends[:-1], ends[1:])]))
        yield batch.set_column(at, "shingles", pa.array(packed, pa.binary()))


def _link_batches(percent: int, ranks: Broadcast) -> Callable[[Batches], Batches]:
    """Links of block pairs, confirmed on full sets, where the bucket is that of their first common shingle.

    Rows (a, b, 0) are a forest of them, rows (a, null, n) their number by class.
    """

    def run(batches: Batches) -> Batches:
        order = ranks.value
        for batch in batches:
            out: list[tuple] = []
            itself = batch.column("cls_y").is_null().to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                gram = np.array([batch.column("gram")[k].as_py()], dtype=np.int64).view(np.uint64)
                rank = _rank(order, gram)[0]
                side = []
                for s in ("",) if itself[k] else ("", "_y"):
                    sets = _unpacked(batch.column("shingles" + s)[k].as_buffer())
                    before = []
                    for own in sets:
                        ranked = _rank(order, own)
                        before.append(own[(ranked < rank) | ((ranked == rank) & (own < gram[0]))])
                    side.append((np.asarray(batch.column("cls" + s)[k].as_py()), sets, before))
                x, y = side[0], side[-1]
                common = common_counts(x[1], y[1])
                sizes = np.add.outer([len(v) for v in x[1]], [len(v) for v in y[1]])
                linked = (common * 100 >= (sizes - common) * percent) & (common_counts(x[2], y[2]) == 0)
                if itself[k]:
                    linked = np.triu(linked, 1)
                a, b = np.nonzero(linked)
                a, b = x[0][a], y[0][b]
                out.extend((u, v, 0) for u, v in _forest(a, b))
                nodes, n = np.unique(np.concatenate((a, b)), return_counts=True)
                out.extend((u, None, c) for u, c in zip(nodes.tolist(), n.tolist()))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b", "n"])

    return run


def _full_sets(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                shingles, offsets = shingle_runs(words(chunk), size)
                rows = len(chunk.offsets) - 1
                sets = [np.unique(shingles[offsets[r] : offsets[r + 1]]).view(np.int64) for r in range(rows)]
                own = batch.slice(chunk.first, rows)
                yield pa.RecordBatch.from_arrays(
                    [own.column("cls"), own.column("buckets"), _lists(sets, pa.int64())], names=["cls", "buckets", "shingles"]
                )

    return run


def _partnered(classes: DataFrame, names: DataFrame, percent: int, work: Staging) -> DataFrame:
    """(doc_id, text_hash, cls, buckets): classes with a partner behind all filters, and the shingles where they have it.

    Of a class's wide row only ``names`` is left afterwards.
    """
    postings = classes.select("cls", F.posexplode("prefix").alias("at", "gram")).select(
        "gram", "cls", (F.col("at") + 1).cast("long").alias("pos")
    )
    several = postings.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    several = several.select("gram", F.ceil(F.col("n") / POSTING_BLOCK).alias("n_blocks"))
    shared = work.table(postings.join(several, "gram"), "shared")
    work.settle()
    hits = F.sort_array(F.collect_list(F.struct("pos", "gram", "n_blocks")))
    described = shared.groupBy("cls").agg(hits.alias("hits")).join(classes, "cls").select(
        "cls", F.col("n_shingles").alias("n"), F.col("hits.gram").alias("grams"), F.col("hits.pos").alias("places"),
        F.col("hits.n_blocks").alias("n_blocks"), "prefix", "cells",
    )
    described = work.table(described.mapInArrow(_posting_batches, _POSTINGS), "postings")
    work.drop("shared", "classes")
    work.settle()
    pairs = _block_pairs(described, _PAYLOAD, work)
    partnered = pairs.mapInArrow(_partner_batches(percent), "gram long, cls long").distinct()
    partnered = work.table(partnered, "partnered")
    work.drop("postings", "blocks")
    work.settle()

    sized = partnered.join(names.select("cls", "doc_id", "text_hash", "n_shingles"), "cls")
    counts = sized.groupBy("gram").agg(F.ceil(F.sum("n_shingles") / SET_BLOCK).alias("n_blocks"))
    buckets = F.collect_list(F.struct("gram", "n_blocks")).alias("buckets")
    return work.table(sized.join(counts, "gram").groupBy("doc_id", "text_hash", "cls").agg(buckets), "wanted")


def _links(
    texts: DataFrame, classes: DataFrame, names: DataFrame, size: int, percent: int, ranks: Broadcast, work: Staging
) -> DataFrame:
    """(a, b, n) of ``_link_batches`` over all classes.

    The few texts with a partner are told by a bitmap before the others could be shuffled, and
    their sets are stored with the buckets they go to, so they travel once, to their blocks.
    """
    wanted = _partnered(classes, names, percent, work)
    key = ["doc_id", "text_hash"]
    # a row that is there several times, id and text, is one text of its class
    chosen = texts.filter(may_hold(key_bits(wanted, *key), *key)).join(wanted, key).dropDuplicates(key)
    sets = chosen.select("cls", "buckets", "text").mapInArrow(_full_sets(size), _FULL_SETS)
    sets = work.table(sets, "sets")
    work.settle()
    rows = sets.select("cls", "shingles", F.explode("buckets").alias("bucket")).select("bucket.*", "cls", "shingles")

    def blocks(rows: DataFrame) -> DataFrame:
        return _blocked(rows, payload).mapInArrow(_packed_batches, _BLOCKS)

    def linked(pairs: DataFrame) -> DataFrame:
        return work.table(pairs.mapInArrow(_link_batches(percent, ranks), "a long, b long, n long"), "links")

    payload = ["cls", "shingles"]
    in_one = linked(_by_itself(blocks(rows.filter(F.col("n_blocks") == 1)), payload))
    work.settle()
    several = work.table(blocks(rows.filter(F.col("n_blocks") > 1)), "blocks")
    work.drop("sets")
    work.settle()
    links = in_one.union(linked(_paired(several, payload)))
    work.drop("blocks")
    work.settle()
    return links


def jaccard_join(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links), one row per input row.

    Words are the runs between ASCII white space, A-Z lower-cased; a document's set holds its
    distinct shingles of ``shingle_words`` words, the whole sequence if it has fewer. Two
    documents link if ``100 * intersection >= percent * union``. ``component_id`` is the smallest
    id reachable over links, ``class_id`` the smallest id with the same set, and ``n_links`` the
    number of other sets that the row's set links with.

    Null and empty texts and texts of white space have no shingle, link with nothing and have
    ``n_links`` 0. Rows with a null id stay alone, with null ``component_id`` and ``class_id``.
    Rows that share an id are one document: what any of them links with is reachable from all,
    and all get the same component. Equal rows are one. Texts of any length are read whole;
    other columns play no part; an empty table gives an empty result. Sets are sets of 64-bit
    hashes of the shingles.
    """
    spark = documents.sparkSession
    as_text = F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_text).alias("text_hash"), as_text.alias("text"))
    ranks = spark.sparkContext.broadcast(rarity(texts, shingle_words))
    with Staging(spark) as work:
        rows = work.table(texts.mapInArrow(_set_batches(shingle_words, percent, ranks), _SETS), "rows")
        filled = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        first = F.min(F.struct("doc_id", "text_hash", "n_shingles", "prefix", "cells")).alias("first")
        classes = filled.groupBy("set_a", "set_b").agg(first)
        classes = work.table(classes.select(F.monotonically_increasing_id().alias("cls"), "set_a", "set_b", "first.*"), "classes")
        # what is wide of rows and classes goes as soon as it has been used
        rows = work.table(rows.select("doc_id", "n_shingles", "set_a", "set_b"), "documents")
        filled = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        names = work.table(classes.select("cls", "set_a", "set_b", "doc_id", "text_hash", "n_shingles"), "names")
        work.drop("rows")
        work.settle()
        links = _links(texts, classes, names, shingle_words, percent, ranks, work)

        names = names.select("set_a", "set_b", "cls", F.col("doc_id").alias("class_id"))
        members = work.table(
            filled.select("doc_id", "n_shingles", "set_a", "set_b").join(names, ["set_a", "set_b"]).drop("set_a", "set_b"), "members"
        )
        spans = members.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a < z").drop("z")
        by_id = members.join(spans, "doc_id").select("a", F.col("cls").alias("b")).filter("a < b")
        edges = links.filter(F.col("b").isNotNull()).select("a", "b").union(by_id)
        joined = components(edges, work=work)
        numbers = links.filter(F.col("b").isNull()).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))

        placed = names.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", "class_id", F.coalesce("component", "cls").alias("component")
        )
        smallest = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
        known = placed.join(smallest, "component").join(numbers, "cls", "left")
        known = work.table(
            known.select("cls", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "known"
        )
        linked = members.join(known, "cls").select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
        empty = rows.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles")
        of_id = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id")
        alone = empty.join(of_id.agg(F.min("component_id").alias("component_id")), "doc_id", "left").select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.col("doc_id").alias("class_id"),
            F.lit(0).cast("long").alias("n_links"),
        )
        return stage(linked.union(alone), "joined")
