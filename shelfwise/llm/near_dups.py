"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures.

Every distinct shingle set gets a signature of 32 components of 16 bits, kept as
eight 64-bit chunks of four components. Two signatures that differ in at most 15
components differ in at most one component of some chunk (pigeonhole: 15 // 8 = 1).
So every chunk is entered under four keys, each with one component wiped out, and two
signatures within the distance always share a key. Sets of similarity 0.8 differ in 6.4 components
on average, in more than 15 with a probability of 1.4e-4, and share no key at all with
one of 1.1e-6 (0.1808 ** 8): whatever shares a key is looked at, at any distance.

Candidates are confirmed on the full shingle sets. Work inside a bucket of equal keys
never grows with the square of a group of copies:

1. equal shingle sets form a class, of which only the smallest id goes on;
2. each member of a bucket is compared with one pivot, first the bucket's smallest id,
   then, where members are still in different components, one drawn by hash;
3. members that are *then still in different components* are compared with each other at
   the first key they share, in pairs of blocks of bounded size: first by set size and
   signature, which leaves the rows that have such a partner, then by their full sets. Out
   of a pair of blocks come rows or links, never candidate pairs.

Two linked texts that share a bucket are therefore in one component at the end.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.key_bits import key_bits, may_hold
from shelfwise.llm.tables import stage
from shelfwise.llm.textscan import Chunk, Words, chunks, mix, mix_int, words
from shelfwise.sources.sinks import Staging

COMPONENTS = 32
COMPONENT_BITS = 16
CHUNKS = 8
MAX_DISTANCE = 15
#: Errors that at least one chunk stays within.
CHUNK_ERRORS = MAX_DISTANCE // CHUNKS

_MULTIPLIERS = np.array([mix_int(1000 + j) | 1 for j in range(COMPONENTS)], dtype=np.uint64)
_PAIR = np.uint64(mix_int(7) | 1)
_ALONE = np.uint64(mix_int(8))
#: A chunk's 64 bits with one component wiped out.
_WIPED = [~(0xFFFF << (16 * k)) & ((1 << 64) - 1) for k in range(4)]

SIGNATURE_SCHEMA = (
    "doc_id long, n_shingles long, set_a long, set_b long, "
    + ", ".join(f"sig{c} long" for c in range(CHUNKS))
)
SETS_SCHEMA = "doc_id long, shingles array<long>"


def shingle_runs(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a chunk, and each row's first; short rows are one shingle."""
    counts = np.diff(found.rows)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate(([0], np.cumsum(per_row)))
    out = np.empty(int(offsets[-1]), dtype=np.uint64)
    # a shingle at every word; those that would run over the row's end are dropped below
    n = len(found.hashes)
    value = found.hashes.copy()
    for k in range(1, min(size, n)):
        value[: n - k] = value[: n - k] * _PAIR + found.hashes[k:]
    long_rows = counts >= size
    at = np.repeat(found.rows[:-1], per_row) + (
        np.arange(len(out)) - np.repeat(offsets[:-1], per_row)
    )
    is_long = np.repeat(long_rows, per_row)
    out[is_long] = mix(value[at[is_long]])
    for row in np.flatnonzero((counts > 0) & ~long_rows):
        total = int(_ALONE) + int(counts[row])
        for h in found.hashes[found.rows[row] : found.rows[row + 1]]:
            total = mix_int((total * int(_PAIR) + int(h)) & ((1 << 64) - 1))
        out[offsets[row]] = total
    return out, offsets


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature chunks of each row, shape (rows, CHUNKS); empty rows get zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, CHUNKS), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    begins = offsets[:-1][filled]
    for j, multiplier in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(shingles * multiplier, begins)
        part = (least >> np.uint64(24)) & np.uint64(0xFFFF)
        out[filled, j // 4] |= part << np.uint64(16 * (j % 4))
    return out


def _signature_batches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                shingles, offsets = shingle_runs(words(chunk), size)
                rows = len(chunk.offsets) - 1
                sizes = np.zeros(rows, dtype=np.int64)
                prints = np.zeros((rows, 2), dtype=np.int64)
                for row in range(rows):
                    own = np.unique(shingles[offsets[row] : offsets[row + 1]])
                    sizes[row] = len(own)
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    prints[row] = np.frombuffer(digest, dtype=np.int64)
                sig = signatures(shingles, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, rows),
                        pa.array(sizes),
                        pa.array(prints[:, 0].copy()),
                        pa.array(prints[:, 1].copy()),
                        *(pa.array(sig[:, c].copy()) for c in range(CHUNKS)),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", *(f"sig{c}" for c in range(CHUNKS))],
                )

    return run


def _set_batches(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                shingles, offsets = shingle_runs(words(chunk), size)
                rows = len(chunk.offsets) - 1
                sets = [np.unique(shingles[offsets[r] : offsets[r + 1]]) for r in range(rows)]
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()),
                    pa.array(values),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, rows), lists], names=["doc_id", "shingles"]
                )

    return run


def set_signatures(documents: DataFrame, shingle_words: int) -> DataFrame:
    """Set size, set fingerprint and signature of every document, in one narrow pass."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return ids.mapInArrow(_signature_batches(shingle_words), SIGNATURE_SCHEMA)


def shingle_sets(documents: DataFrame, shingle_words: int) -> DataFrame:
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return ids.mapInArrow(_set_batches(shingle_words), SETS_SCHEMA)


def _masked(sig: Column, wiped: int) -> Column:
    signed = wiped - (1 << 64) if wiped >= 1 << 63 else wiped
    return sig.bitwiseAND(F.lit(signed).cast("long"))


def _keys() -> Column:
    """All bucket keys of a signature, by slot: every chunk under every allowed error."""
    return F.array(
        *(
            F.xxhash64(F.lit(len(_WIPED) * c + k), _masked(F.col(f"sig{c}"), wiped))
            for c in range(CHUNKS)
            for k, wiped in enumerate(_WIPED)
        )
    )


def _first_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first slot in which pairs of signatures (pairs, COMPONENTS) have the same key, or -1."""
    equal = (left == right).reshape(len(left), CHUNKS, COMPONENTS // CHUNKS)
    errors = (~equal).sum(axis=2)
    chunk = (errors <= CHUNK_ERRORS).argmax(axis=1)
    at = np.arange(len(left))
    wiped = np.where(errors[at, chunk] == 0, 0, equal[at, chunk].argmin(axis=1))
    return np.where(errors[at, chunk] <= CHUNK_ERRORS, len(_WIPED) * chunk + wiped, -1)


#: Rows of a block of signatures and of a block of sets, and pairs looked at together.
SIGNATURE_BLOCK = 512
SET_BLOCK = 128
PAIRS_AT_ONCE = 1 << 17
_SET_SLICE = 4096


def _size_class(n: Column, percent: int) -> Column:
    """Sets of fitting sizes are in the same class or in neighbouring ones."""
    if percent >= 100:
        return n.cast("int")
    # a little wider than the sizes allow, so that rounding parts none
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) * (1 - 1e-6)).cast("int")


def _blocks(rows: DataFrame, size: int, payload: list[str], percent: int, work: Staging) -> DataFrame:
    """Rows of each key in blocks of about ``size``, paired with the blocks of the same key.

    Blocks hold rows of one size class, and meet those of their own and the next class only.
    A class's rows are dealt out by id, so no group grows with the key; a block also meets
    itself. The columns of the second block end in ``_y``.
    """
    classed = rows.withColumn("size_class", _size_class(F.col("n_b"), percent))
    counts = classed.groupBy("key", "size_class").agg(
        F.ceil(F.count("*") / size).alias("n_blocks"), F.min("part").alias("low"), F.max("part").alias("high")
    )
    near = counts.select("key", "size_class", "low", "high")
    # classes that hold one component only, and whose neighbours hold no other, have no pair to look at
    around = near.select("key", F.explode(F.array(*(F.col("size_class") + d for d in (-1, 0, 1)))).alias("size_class"), "low", "high")
    several = (
        around.groupBy("key", "size_class").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(F.col("low") < F.col("high")).select("key", "size_class")
    )
    counts = counts.drop("low", "high").join(several, ["key", "size_class"])
    block = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))
    made = (
        classed.join(counts, ["key", "size_class"])
        .groupBy("key", "slot", "size_class", block.alias("block"))
        .agg(F.collect_list(F.struct(*payload)).alias("rows"))
        .select("key", "slot", "size_class", "block", *(F.col(f"rows.{c}").alias(c) for c in payload))
    )
    made = work.table(made, "blocks")
    x, y = made.alias("x"), made.alias("y")
    own = (F.col("x.size_class") == F.col("y.size_class")) & (F.col("x.block") <= F.col("y.block"))
    met = own | (F.col("x.size_class") + 1 == F.col("y.size_class"))
    same = (F.col("x.size_class") == F.col("y.size_class")) & (F.col("x.block") == F.col("y.block"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & met).select(
        "x.key",
        "x.slot",
        same.alias("same"),
        *(F.col(f"x.{c}").alias(c) for c in payload),
        *(F.col(f"y.{c}").alias(f"{c}_y") for c in payload),
    )


def _pair_index(n: int, m: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        return np.triu_indices(n, 1)
    return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)


def _partner_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of block pairs that have a partner of fitting size in another component, by the first key of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = {}
            for name in ("doc_id", "part", "n_b", *(f"sig{c}" for c in range(CHUNKS))):
                for suffix in ("", "_y"):
                    fields[name + suffix] = batch.column(name + suffix).flatten().to_numpy()
            lists = {s: batch.column("doc_id" + s) for s in ("", "_y")}
            firsts = {s: np.concatenate(([0], np.cumsum(np.diff(v.offsets.to_numpy())))) for s, v in lists.items()}
            signature = {
                s: np.stack([fields[f"sig{c}{s}"] for c in range(CHUNKS)], axis=1).view(np.uint16)
                for s in ("", "_y")
            }
            keys, slots = batch.column("key").to_numpy(), batch.column("slot").to_numpy()
            same = batch.column("same").to_pylist()
            left, right, owner, held, out = [], [], [], 0, []

            def looked_at() -> None:
                a, b, row = map(np.concatenate, (left, right, owner))
                n_a, n_b = fields["n_b"][a], fields["n_b_y"][b]
                keep = (fields["part"][a] != fields["part_y"][b]) & (
                    np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
                )
                a, b, row = a[keep], b[keep], row[keep]
                keep = _first_slots(signature[""][a], signature["_y"][b]) == slots[row]
                a, b, row = a[keep], b[keep], row[keep]
                if len(a):
                    ids = np.concatenate((fields["doc_id"][a], fields["doc_id_y"][b]))
                    out.append(np.unique(np.stack((np.tile(keys[row], 2), np.tile(slots[row], 2), ids)), axis=1))

            for k in range(batch.num_rows):
                n, m = firsts[""][k + 1] - firsts[""][k], firsts["_y"][k + 1] - firsts["_y"][k]
                a, b = _pair_index(n, m, same[k])
                left.append(a + firsts[""][k])
                right.append(b + firsts["_y"][k])
                owner.append(np.full(len(a), k))
                held += len(a)
                if held >= PAIRS_AT_ONCE:
                    looked_at()
                    left, right, owner, held = [], [], [], 0
            if held:
                looked_at()
            if out:
                found = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2])],
                    names=["key", "slot", "doc_id"],
                )

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets.

    Products of 0-1 matrices, a slice of the shared values at a time, so memory doesn't
    grow with the sets.
    """
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        sides.append((values[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    for first in range(0, len(shared), _SET_SLICE):
        part = shared[first : first + _SET_SLICE]
        marks = []
        for (values, rows), n in zip(sides, total.shape):
            a, b = np.searchsorted(values, part[0]), np.searchsorted(values, part[-1], "right")
            at = np.searchsorted(part, values[a:b])
            known = part[at] == values[a:b]
            mark = np.zeros((n, len(part)), dtype=np.float32)
            mark[rows[a:b][known], at[known]] = 1
            marks.append(mark)
        total += marks[0] @ marks[1].T
    return total.astype(np.int64)


def _link_batches(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between components, confirmed on the full sets of block pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                side = []
                for s in ("", "_y"):
                    ids, parts = (np.asarray(batch.column(c + s)[k].as_py()) for c in ("doc_id", "part"))
                    lists = batch.column("shingles" + s)[k].values
                    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                    side.append((ids, parts, [values[a:b] for a, b in zip(ends[:-1], ends[1:])]))
                (ids, parts, sets), (ids_y, parts_y, sets_y) = side
                common = common_counts(sets, sets_y)
                sizes = np.add.outer([len(x) for x in sets], [len(x) for x in sets_y])
                linked = (common * 100 >= (sizes - common) * percent) & (parts[:, None] != parts_y)
                a, b = np.nonzero(linked)
                out.append(np.stack((np.minimum(ids[a], ids_y[b]), np.maximum(ids[a], ids_y[b]))))
            found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return run


def _similar(percent: int, n_a: str, n_b: str) -> Column:
    """Set sizes that allow the similarity at all."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("in_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("in_a")), "a")
    common = F.size(F.array_intersect("in_a", "in_b")).cast("long")
    union = F.size("in_a") + F.size("in_b") - F.col("common")
    return (
        both.select("a", "b", "in_a", "in_b", common.alias("common"))
        .filter(F.col("common") * 100 >= union * percent)
        .select("a", "b")
    )


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with the component as ``part``."""
    named = members.join(found.withColumnRenamed("node", "b"), "b", "left").withColumn(
        "part", F.coalesce("component", "b")
    )
    several = (
        named.groupBy("key")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .filter(F.col("low") < F.col("high"))
    )
    return named.join(several, "key", "left_semi").select("key", "slot", "b", "n_b", "part")


def near_duplicates(
    documents: DataFrame, shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_links), one row per input row.

    Words are the runs between ASCII white space, A-Z lower-cased; a document's set
    holds its distinct shingles of ``shingle_words`` words, the whole sequence if it
    has fewer. Documents are linked if ``100 * intersection >= percent * union``, and
    ``component_id`` is the smallest id reachable over links. ``class_id`` is the
    smallest id with the same set; ``n_links`` counts the confirmed links of that class
    which the search used, not all links inside a group of copies.

    Null and empty texts and texts of white space have no shingle and link with nothing.
    Rows with a null id stay alone, with null ``component_id`` and ``class_id``, and are
    kept. Rows that share an id are one document: what any of them links with is reachable
    from all, and all get the same component. Texts of any length are read whole. Other
    columns of the input play no part. An empty table gives an empty result.
    """
    with Staging(documents.sparkSession) as work:
        found = stage(_near_duplicates(documents, shingle_words, percent, work), "near-duplicates")
    work.settle()
    return found


def _near_duplicates(documents: DataFrame, shingle_words: int, percent: int, work: Staging) -> DataFrame:
    signed = work.table(set_signatures(documents, shingle_words), "signatures")
    filled = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = filled.groupBy("set_a", "set_b").agg(
        F.min(F.struct("doc_id", "n_shingles", *(f"sig{c}" for c in range(CHUNKS)))).alias("first")
    )
    classes = work.table(classes.select("set_a", "set_b", "first.*"), "classes")

    keys = classes.select(
        F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.posexplode(_keys()).alias("slot", "key")
    )
    buckets = (
        keys.groupBy("key")
        .agg(F.min(F.struct("b", "n_b")).alias("low"), F.max("b").alias("high"))
        .filter(F.col("low.b") < F.col("high"))
        .select("key", F.col("low.b").alias("a"), F.col("low.n_b").alias("n_a"))
    )
    members = work.table(keys.join(buckets, "key"), "members")
    needed = work.table(members.select(F.col("b").alias("doc_id")).distinct(), "needed")
    work.settle()
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(may_hold(key_bits(needed, "doc_id"), "doc_id"))
    sets = work.table(shingle_sets(own.join(needed, "doc_id", "left_semi"), shingle_words), "sets")
    work.settle()

    stars = members.filter((F.col("a") != F.col("b")) & _similar(percent, "n_a", "n_b"))
    links = work.table(_confirmed(stars.select("a", "b").distinct(), sets, percent), "links")
    work.settle()

    found = components(links, work=work)
    mixed = work.table(_mixed(members.select("key", "slot", "b", "n_b"), found), "mixed")
    drawn = mixed.groupBy("key").agg(
        F.min_by(F.struct("b", "n_b", "part"), F.xxhash64("b", "key")).alias("pivot")
    )
    stars = mixed.join(drawn, "key").filter(
        (F.col("part") != F.col("pivot.part")) & _similar(percent, "n_b", "pivot.n_b")
    )
    stars = stars.select(F.col("pivot.b").alias("a"), "b").distinct()
    links = work.table(links.union(_confirmed(stars, sets, percent)), "links")
    work.settle()

    found = components(links, work=work)
    mixed = _mixed(mixed.select("key", "slot", "b", "n_b"), found).withColumnRenamed("b", "doc_id")
    mixed = work.table(mixed, "mixed")
    signed_rows = mixed.join(classes.drop("set_a", "set_b", "n_shingles"), "doc_id")
    payload = ["doc_id", "part", "n_b", *(f"sig{c}" for c in range(CHUNKS))]
    partnered = (
        _blocks(signed_rows, SIGNATURE_BLOCK, payload, percent, work)
        .mapInArrow(_partner_batches(percent), "key long, slot int, doc_id long")
        .distinct()
    )
    partnered = work.table(partnered, "partnered")
    work.settle()
    with_sets = mixed.join(partnered, ["key", "slot", "doc_id"], "left_semi").join(sets, "doc_id")
    across = (
        _blocks(with_sets, SET_BLOCK, ["doc_id", "part", "shingles"], percent, work)
        .mapInArrow(_link_batches(percent), "a long, b long")
        .distinct()
    )
    links = work.table(links.union(across).distinct(), "links")
    work.settle()

    names = classes.select("set_a", "set_b", F.col("doc_id").alias("class_id"))
    members = filled.select("doc_id", "n_shingles", "set_a", "set_b").join(names, ["set_a", "set_b"])
    members = work.table(members.drop("set_a", "set_b"), "rows")
    spans = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).filter("a < z").drop("z")
    by_id = members.join(spans, "doc_id").select("a", F.col("class_id").alias("b")).filter("a < b")
    joined = components(links.union(by_id), work=work)

    counts = (
        links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    )
    component = F.coalesce("component", "class_id")
    linked = (
        members.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        .join(counts, "class_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            (F.col("doc_id") == component).alias("kept"),
            "class_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
    )
    empty = signed.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles")
    of_id = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id")
    own = F.coalesce("component_id", "doc_id")
    alone = empty.join(of_id.agg(F.min("component_id").alias("component_id")), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return linked.union(alone)


def deduplicated(documents: DataFrame, shingle_words: int = 2, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each group the row with the smallest id stays.

    Rows are told apart by id and text: each pair of them is a document of its own, and of
    rows equal in both one stays. A row of which only the id is repeated is judged by its
    own text. Rows with a null id all stay. Columns are those of the input.
    """
    row_key = f"_row_key_{uuid.uuid4().hex}"
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    keyed = documents.withColumn(row_key, key)
    rows = keyed.select(F.col(row_key).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Staging(documents.sparkSession) as work:
        found = near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), shingle_words, percent)
        names = rows.filter(F.col("row_key").isNotNull()).groupBy("row_key").agg(
            F.min("doc_id").alias("own_id"), F.count("*").alias("n")
        )
        names = work.table(names, "row-keys")
        judged = found.select(F.col("doc_id").alias("row_key"), "component_id").distinct().join(names, "row_key")
        first = judged.groupBy("component_id").agg(F.min(F.struct("own_id", "row_key")).alias("first"))
        first = first.select(F.col("first.row_key").alias("row_key"))
        removed = stage(judged.join(first, "row_key", "left_anti").select(F.col("row_key").alias(row_key)), "removed")
        repeated = stage(names.filter("n > 1").select(F.col("row_key").alias(row_key)), "repeated")
    work.settle()
    # rows that are surely neither removed nor repeated stay as they are, without a shuffle of their texts
    marked = may_hold(key_bits(removed.union(repeated), row_key), row_key)
    left = keyed.filter(marked).join(removed, row_key, "left_anti")
    if not repeated.isEmpty():
        single = left.join(repeated, row_key, "left_anti")
        left = single.unionByName(left.join(repeated, row_key, "left_semi").dropDuplicates(["doc_id", "text"]))
    left = left.unionByName(keyed.filter(~marked))
    return left.select(*(F.col(f"`{c}`") for c in documents.columns))
