"""Benchmark decontamination with a distributed positional inverted index.

The documents are cut into segments of whole texts. Each segment is one row of the
stored index: the terms it holds, the length of each term's posting list, and the
lists themselves, as word positions within the segment. One free position between two
texts keeps phrases from running over. A segment needs nothing from any other, so
building and searching are narrow and a common term is split over all segments.

A test phrase is looked up by its rarest term: that list, moved back by the term's
place in the phrase, is intersected with the moved lists of the other terms in order
of their lengths, so it shrinks before long lists are touched. Phrases that lack a
term in a segment are dropped for all phrases at once.

Only words that occur in the test set are indexed; a larger test vocabulary than
``MAX_VOCABULARY`` indexes every word instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage
from shelfwise.llm.textscan import ALNUM, chunks, ragged, words

WINDOW = 13
SEGMENT_BYTES = 4 << 20
#: Test words that travel to the tasks at once; a larger test set takes more passes.
WORDS_PER_PASS = 1_000_000
MAX_VOCABULARY = 4_000_000

INDEX_SCHEMA = (
    "segment long, doc_ids array<long>, text_hashes array<long>, n_words array<int>, terms array<long>,"
    " counts array<int>, positions array<int>"
)
ITEM_SCHEMA = "item_id long, terms array<long>"
HIT_SCHEMA = "segment long, row int, items array<long>, covered array<int>"
NEAR_SCHEMA = "doc_id long, item_id long, first_word int, last_word int"

Batches = Iterator[pa.RecordBatch]


def _item_batches(batches: Batches) -> Batches:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            found = words(chunk, ALNUM)
            rows = len(chunk.offsets) - 1
            terms = ragged(found.hashes.view(np.int64), np.diff(found.rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, rows), terms], names=["item_id", "terms"]
            )


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms): the word hashes of each test text."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    return own.mapInArrow(_item_batches, ITEM_SCHEMA)


def passes(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The test items in groups of about ``WORDS_PER_PASS`` words."""
    group, size = [], 0
    for row in items.toLocalIterator():
        terms = np.array(row["terms"], dtype=np.int64)
        if len(terms):
            group.append((row["item_id"], terms))
            size += len(terms)
        if size >= WORDS_PER_PASS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _index_batches(vocabulary: np.ndarray | None) -> Callable[[Batches], Batches]:
    """vocabulary: sorted hashes to index, None for all."""

    def run(batches: Batches) -> Batches:
        known = None
        if vocabulary is not None:
            # a bit table lets most other words pass by without a search
            size = max(16, int(len(vocabulary) * 16 - 1).bit_length())
            shift = np.uint64(64 - size)
            known = np.zeros(1 << size, dtype=bool)
            known[(vocabulary.view(np.uint64) >> shift).astype(np.int64)] = True
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in chunks(batch.column(1), SEGMENT_BYTES):
                found = words(chunk, ALNUM)
                rows = len(chunk.offsets) - 1
                counts = np.diff(found.rows)
                place = np.arange(len(found.hashes)) + np.repeat(np.arange(rows), counts)
                terms = found.hashes.view(np.int64)
                if known is not None:
                    maybe = np.flatnonzero(known[(found.hashes >> shift).astype(np.int64)])
                    at = np.searchsorted(vocabulary, terms[maybe])
                    at[at == len(vocabulary)] = 0
                    maybe = maybe[vocabulary[at] == terms[maybe]] if len(vocabulary) else maybe[:0]
                    place, terms = place[maybe], terms[maybe]
                order = np.argsort(terms, kind="stable")
                terms, place = terms[order], place[order]
                firsts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, int)
                lengths = np.diff(np.concatenate((firsts, [len(terms)])))
                one = lambda values, kind: ragged(values, [len(values)], kind)
                own = lambda column: pa.ListArray.from_arrays(
                    pa.array([0, rows], pa.int32()), column.slice(chunk.first, rows)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        own(batch.column(0)),
                        own(batch.column(2)),
                        one(counts, pa.int32()),
                        one(terms[firsts], pa.int64()),
                        one(lengths, pa.int32()),
                        one(place, pa.int32()),
                    ],
                    names=["segment", "doc_ids", "text_hashes", "n_words", "terms", "counts", "positions"],
                )
                number += 1

    return run


def positional_index(documents: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """Segments with posting lists; not stored yet."""
    own = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    return own.mapInArrow(_index_batches(vocabulary), INDEX_SCHEMA)


class Segment:
    """A segment's row as arrays."""

    def __init__(self, row: dict):
        self.number = row["segment"].as_py()
        self.doc_ids = row["doc_ids"].values
        self.n_words = row["n_words"].values.to_numpy()
        self.terms = row["terms"].values.to_numpy()
        self.counts = row["counts"].values.to_numpy()
        self.begins = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))
        self.positions = row["positions"].values.to_numpy()
        #: position of each text's first word
        self.firsts = np.concatenate(([0], np.cumsum(self.n_words + 1, dtype=np.int64)[:-1]))

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term in the term list, -1 if absent."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        if not len(self.terms):
            return np.full(terms.shape, -1)
        return np.where(self.terms[at] == terms, at, -1)

    def list_of(self, place: int) -> np.ndarray:
        return self.positions[self.begins[place] : self.begins[place + 1]]

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Positions at which the phrase of these terms begins."""
        order = np.argsort(self.counts[places], kind="stable")
        starts = self.list_of(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            own = self.list_of(places[k])
            at = np.searchsorted(own, starts + k)
            at[at == len(own)] = 0
            starts = starts[own[at] == starts + k]
        return starts

    def near(self, places: np.ndarray, reach: int) -> list[tuple[int, int]]:
        """Shortest stretches of at most ``reach`` words that hold all the terms, in any order."""
        places = np.unique(places)
        order = places[np.argsort(self.counts[places], kind="stable")]
        lists = [self.list_of(p).astype(np.int64) for p in order]
        rarest, ends = lists[0], np.unique(np.concatenate(lists))
        near = np.searchsorted(rarest, ends - reach + 1) < np.searchsorted(rarest, ends, "right")
        ends = ends[near]
        left = ends.copy()
        for own in lists:
            at = np.searchsorted(own, ends, "right") - 1
            left = np.minimum(left, np.where(at < 0, -(1 << 40), own[at]))
        same = np.searchsorted(self.firsts, left, "right") == np.searchsorted(self.firsts, ends, "right")
        fits = (ends - left < reach) & same
        best: dict[int, int] = {}
        for first, last in zip(left[fits].tolist(), ends[fits].tolist()):
            best[first] = min(best.get(first, last), last)
        return sorted(best.items())


def _segments(batches: Batches) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment({name: batch.column(name)[k] for name in batch.schema.names})


def _windows(items: list[tuple[int | None, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, item of each): all windows of full size, then each shorter item as one window."""
    full = [(i, terms) for i, (_, terms) in enumerate(items) if len(terms) >= size]
    if full:
        views = [np.lib.stride_tricks.sliding_window_view(terms, size) for _, terms in full]
        yield np.concatenate(views), np.repeat([i for i, _ in full], [len(v) for v in views])
    for i, (_, terms) in enumerate(items):
        if len(terms) < size:
            yield terms.reshape(1, -1), np.array([i])


def _hit_batches(shared, size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        items = shared.value
        groups = list(_windows(items, size))
        for segment in _segments(batches):
            starts, lengths, owners = [], [], []
            for windows, owner in groups:
                places = segment.places(windows)
                for w in np.flatnonzero((places >= 0).all(axis=1)):
                    found = segment.phrase(places[w])
                    if len(found):
                        starts.append(found)
                        lengths.append(np.full(len(found), windows.shape[1]))
                        owners.append(np.full(len(found), owner[w]))
            if not starts:
                continue
            start, length, owner = map(np.concatenate, (starts, lengths, owners))
            rows = np.searchsorted(segment.firsts, start, "right") - 1
            order = np.argsort(rows, kind="stable")
            start, length, owner, rows = start[order], length[order], owner[order], rows[order]
            cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
            out_rows, out_items, out_covered = [], [], []
            for a, b in zip(cut[:-1], cut[1:]):
                row = int(rows[a])
                marks = np.zeros(segment.n_words[row] + 1, dtype=np.int64)
                begins = start[a:b] - segment.firsts[row]
                np.add.at(marks, begins, 1)
                np.add.at(marks, begins + length[a:b], -1)
                out_rows.append(row)
                out_covered.append(np.flatnonzero(np.cumsum(marks[:-1]) > 0).tolist())
                out_items.append(sorted({items[i][0] for i in np.unique(owner[a:b])} - {None}))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment.number] * len(out_rows), pa.int64()),
                    pa.array(out_rows, pa.int32()),
                    pa.array(out_items, pa.list_(pa.int64())),
                    pa.array(out_covered, pa.list_(pa.int32())),
                ],
                names=["segment", "row", "items", "covered"],
            )

    return run


def _near_batches(shared, slop: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for segment in _segments(batches):
            out = []
            for item_id, terms in shared.value:
                places = segment.places(terms)
                if (places < 0).any():
                    continue
                for first, last in segment.near(places, len(terms) + slop):
                    row = int(np.searchsorted(segment.firsts, first, "right")) - 1
                    begin = int(segment.firsts[row])
                    out.append((segment.doc_ids[row].as_py(), item_id, first - begin, last - begin))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                    names=["doc_id", "item_id", "first_word", "last_word"],
                )

    return run


def _index_and_passes(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list]:
    spark = documents.sparkSession
    groups, vocabulary = [], np.empty(0, dtype=np.int64)
    for group in passes(item_terms(benchmark)):
        if vocabulary is not None:
            vocabulary = np.union1d(vocabulary, np.concatenate([terms for _, terms in group]))
            if len(vocabulary) > MAX_VOCABULARY:
                vocabulary = None
        groups.append(spark.sparkContext.broadcast(group))
    return stage(positional_index(documents, vocabulary), "index"), groups


def _judged(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The rows of ``contamination`` with a hash of the text."""
    index, groups = _index_and_passes(documents, benchmark)
    rows = index.select(
        "segment",
        F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("row", "d"),
    ).select(
        "segment",
        "row",
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.text_hashes").alias("text_hash"),
        F.col("d.n_words").cast("long").alias("n_words"),
    )
    hits = None
    for shared in groups:
        found = index.mapInArrow(_hit_batches(shared, window), HIT_SCHEMA)
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = documents.sparkSession.createDataFrame([], HIT_SCHEMA)
    merged = hits.groupBy("segment", "row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(merged, ["segment", "row"], "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated), one row per document row.

    A window is ``window`` consecutive words of a test text, or the whole of a shorter
    one; a document word inside any occurrence of a window is hit. ``items`` are the
    ids of the test texts with such windows, sorted and distinct. A document is
    contaminated if at least a twentieth of its words are hit, and one at least.

    Null texts and texts without words have no words and are clean. Test texts without
    words are ignored; those without an id count but are not listed. Rows with equal or
    null ids are judged row by row. An empty test set leaves everything clean, an empty
    document table gives an empty result; other columns play no part.
    """
    return _judged(documents, benchmark, window).drop("text_hash")


def proximity_matches(documents: DataFrame, benchmark: DataFrame, slop: int = 10) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): where all words of a test text lie close together.

    Each match is a shortest stretch of at most the test text's length plus ``slop``
    words that holds all its distinct words, in any order; words count from 0.
    """
    index, groups = _index_and_passes(documents, benchmark)
    found = None
    for shared in groups:
        part = index.mapInArrow(_near_batches(shared, slop), NEAR_SCHEMA)
        found = part if found is None else found.union(part)
    return documents.sparkSession.createDataFrame([], NEAR_SCHEMA) if found is None else found


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with the columns of the input.

    Rows are told apart by id and text, so null and repeated ids lose only bad texts.
    """
    bad = (
        _judged(documents, benchmark, window)
        .filter("contaminated")
        .select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
        .distinct()
    )
    same = documents["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (
        F.xxhash64(documents["text"]) == bad["bad_hash"]
    )
    return documents.join(bad, same, "left_anti")
