"""Grouping of spelling variants: PartEnum signatures over letter multisets.

Two words one edit apart have letter multisets that differ in at most two elements: one
more letter after an insertion, one letter gone and one come after a replacement. A
multiset is a binary vector with one dimension for every (letter, occurrence): ``anna`` has
(a, 1), (a, 2), (n, 1), (n, 2). The dimensions are dealt into ``PARTS`` parts of about equal
information. Vectors of Hamming distance two agree outside of some two parts, vectors of
distance one outside of some one part. So a word is entered under one signature for every
choice of parts left out:

* two parts out and its own length, to meet words of equal length (a replacement);
* one part out and its own length as the longer word, and one part out and its length
  plus one as the shorter word (an insertion or deletion).

Words one edit apart share a signature without exception. Signatures are joined by
equality, and the edit distance is verified in the join, so that no pair comes out of it
but those of near words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage
from shelfwise.llm.textscan import LOWER, SPACED, Chunk, chunks, mix, mix_int, words
from shelfwise.sources.sinks import Staging

PARTS = 6
#: Occurrences of a letter from this one on lie in the same part.
OCCURRENCES = 4
#: Words a task counts before it hands its counts on, and bytes of text read at once.
COUNTED_WORDS = 400_000
TEXT_BYTES = 4 << 20
#: Longer words get their checksum one by one.
_TABLED_BYTES = 64

_IS_ASCII_LETTER = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
#: The first byte of U+00C0 to U+00FF, and of nothing else.
_LATIN_LEAD = 0xC3
_PART_FACTORS = np.array([mix_int(300 + j) | 1 for j in range(PARTS)], dtype=np.uint64)

#: Sides of a signature: words of equal length, the shorter and the longer of two.
EQUAL, SHORTER, LONGER = 0, 1, 2


def _letters_only(chunk: Chunk) -> Chunk:
    """The chunk in lower case (A-Z) with a space for every byte outside of a run of letters."""
    data = LOWER[chunk.data]
    lead = data == _LATIN_LEAD
    inside = _IS_ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return Chunk(chunk.first, np.where(inside, data, 32).astype(np.uint8), chunk.offsets)


@lru_cache(maxsize=_TABLED_BYTES)
def _after_bytes(n: int) -> np.ndarray:
    """Tables (4, 256) that carry a crc32 over ``n`` more bytes, but for those bytes' own crc32."""
    bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
    step = one ^ one[0]  # linear part of one byte's step
    for _ in range(n):
        bits = step[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
    out = np.zeros((4, 256), dtype=np.uint32)
    for b in range(256):
        for k in range(4):
            for bit in range(8):
                if b >> bit & 1:
                    out[k, b] ^= bits[8 * k + bit]
    return out


def _checksums(prefixes: np.ndarray, word_sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of prefix and word together, from the crc32 of both and the word's length in bytes."""
    out = word_sums.copy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        p, tables = prefixes[at], _after_bytes(int(n))
        for k in range(4):
            out[at] ^= tables[k][(p >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def _count_chunk(counts: Counter, chunk: Chunk, ids: list[str | None], least_letters: int, misspell: int | None) -> None:
    letters = _letters_only(chunk)
    found = words(letters, SPACED, lower=False)
    sizes = found.ends - found.starts
    leads = np.concatenate(([0], np.cumsum(letters.data == _LATIN_LEAD)))
    long_enough = np.flatnonzero(sizes - (leads[found.ends] - leads[found.starts]) >= least_letters)
    if not len(long_enough):
        return
    _, first, own = np.unique(found.hashes[long_enough], return_index=True, return_inverse=True)
    first = long_enough[first]
    data = letters.data.tobytes()
    distinct = [data[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())]
    damaged = np.zeros(len(long_enough), dtype=bool)
    if misspell:
        row = np.searchsorted(found.rows, long_enough, "right") - 1
        prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)[row]
        sums = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint32)
        lengths = sizes[long_enough]
        short = lengths <= _TABLED_BYTES
        hashes = np.zeros(len(long_enough), dtype=np.uint32)
        hashes[short] = _checksums(prefixes[short], sums[own[short]], lengths[short])
        for k in np.flatnonzero(~short):
            hashes[k] = zlib.crc32(distinct[own[k]], int(prefixes[k]))
        damaged = hashes % np.uint32(misspell) == 0
        for k in np.flatnonzero(damaged):
            word = distinct[own[k]].decode()
            shorter = _without(word, int(hashes[k]) % len(word))
            if len(shorter) >= least_letters:
                counts[shorter] += 1
    number = np.bincount(own[~damaged], minlength=len(distinct))
    for k in np.flatnonzero(number):
        counts[distinct[k].decode()] += int(number[k])


def _count_batches(least_letters: int, misspell: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), TEXT_BYTES):
                rows = len(chunk.offsets) - 1
                _count_chunk(counts, chunk, ids[chunk.first : chunk.first + rows], least_letters, misspell)
                if len(counts) >= COUNTED_WORDS:
                    yield counted()
        if counts:
            yield counted()

    return run


def word_counts(documents: DataFrame, least_letters: int = 5, misspell: int | None = None) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased,
    of ``least_letters`` code points or more. With ``misspell`` some occurrences lose a
    letter first, the same in every run: where the crc32 of ``<doc_id>:<word>`` is a
    multiple of ``misspell``, the code point at that crc32 modulo the word's length.

    Null texts have no word; a null id counts as an empty one. Tasks count before they
    shuffle, so a very frequent word is one row a task and ``COUNTED_WORDS`` words.
    """
    texts = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counted = texts.mapInArrow(_count_batches(least_letters, misspell), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _dimensions(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point and occurrence (from 0) of every letter, word by word, and each word's first."""
    lengths = np.array([len(w) for w in found])
    points = np.frombuffer("".join(found).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(found)), lengths)
    order = np.lexsort((points, owner))
    points, owner = points[order], owner[order]
    place = np.arange(len(points))
    same = np.zeros(len(points), dtype=bool)
    same[1:] = (points[1:] == points[:-1]) & (owner[1:] == owner[:-1])
    run = np.maximum.accumulate(np.where(same, 0, place))
    return points, place - run, np.concatenate(([0], np.cumsum(lengths)))


def _dimension_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for w in batch.column(0).to_pylist() if w]
        if found:
            points, occurrence, _ = _dimensions(found)
            held, n = np.unique(points * OCCURRENCES + np.minimum(occurrence, OCCURRENCES - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["dimension", "n"])


def _parts(found: DataFrame) -> dict[int, int]:
    """The part of each dimension: the most informative first, each to the lightest part.

    There are at most ``OCCURRENCES`` dimensions a letter of the alphabet.
    """
    held = found.select("word").mapInArrow(_dimension_batches, "dimension long, n long")
    rows = held.groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    total = max([1, *(r["n"] for r in rows)]) + 1
    shares = {r["dimension"]: min(max(r["n"] / total, 1e-9), 1 - 1e-9) for r in rows}
    bits = {d: -p * np.log2(p) - (1 - p) * np.log2(1 - p) for d, p in shares.items()}
    load, out = [0.0] * PARTS, {}
    for dimension in sorted(bits, key=lambda d: (-bits[d], d)):
        part = load.index(min(load))
        out[dimension] = part
        load[part] += bits[dimension]
    return out


def _tag(out: tuple[int, ...]) -> int:
    """Of the parts left out: one for words of unequal, two for words of equal length."""
    return mix_int(sum(1 << p for p in out))


def _ends(found: list[str], longer: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last letters of each word as numbers: two of each, or fewer of short words.

    One edit leaves one end of a word as it is, so near words agree in one of the two;
    ``longer`` is how many letters the word has more than the shorter one it is to meet.
    """
    sizes = [min(2, (len(w) - longer) // 2) for w in found]
    number = lambda t: sum(ord(c) * 257**k for k, c in enumerate(t)) % 2**31
    heads = np.array([number(w[:k]) for w, k in zip(found, sizes)], dtype=np.int32)
    return heads, np.array([number(w[len(w) - k :]) for w, k in zip(found, sizes)], dtype=np.int32)


def _signature_batches(parts: dict[int, int], shorter: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signatures of one side of the join: for equal lengths, and as the shorter or the longer word."""
    side, added = (SHORTER, 1) if shorter else (LONGER, 0)
    known = np.array(sorted(parts), dtype=np.int64)
    part_of = np.array([parts[d] for d in known.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            found = column.to_pylist()
            if not found:
                continue
            points, occurrence, offsets = _dimensions(found)
            held = points * OCCURRENCES + np.minimum(occurrence, OCCURRENCES - 1)
            part = part_of[np.searchsorted(known, held)]
            element = mix((points.astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64))
            sums = np.stack(
                [np.add.reduceat(np.where(part == j, element, np.uint64(0)), offsets[:-1]) for j in range(PARTS)]
            )
            sums *= _PART_FACTORS[:, None]
            total = sums.sum(axis=0, dtype=np.uint64)
            length = np.diff(offsets).astype(np.uint64)
            ends = {EQUAL: _ends(found, 0), side: _ends(found, 1 - added)}
            keys, sides = [], []

            def enter(as_side: int, out: tuple[int, ...], size: np.ndarray) -> None:
                rest = total - sums[list(out)].sum(axis=0, dtype=np.uint64)
                keys.append(mix(mix(rest ^ np.uint64(_tag(out))) ^ mix(size)))
                sides.append(as_side)

            for out in combinations(range(PARTS), 2):
                enter(EQUAL, out, length)
            for j in range(PARTS):
                enter(side, (j,), length + np.uint64(added))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(np.array(sides, dtype=np.int32), n)),
                    pa.array(np.concatenate([ends[s][0] for s in sides])),
                    pa.array(np.concatenate([ends[s][1] for s in sides])),
                    column.take(pa.array(np.tile(np.arange(n), len(sides)))),
                ],
                names=["key", "side", "head", "tail", "word"],
            )

    return run


def near_words(found: DataFrame) -> DataFrame:
    """(a, b): all pairs of words exactly one insertion, deletion or replacement apart, each once.

    ``found`` has distinct words in its column ``word``; null and empty ones have no near
    word. The signatures are joined by equality; adaptive execution splits a signature that
    very many words share. Catalyst sizes the signatures as one row a word, where there are
    many, so the join is told not to broadcast them.
    """
    filled = found.filter(F.col("word") != "").select("word")
    parts, schema = _parts(filled), "key long, side int, head int, tail int, word string"
    x = filled.mapInArrow(_signature_batches(parts, shorter=True), schema).alias("x")
    y = filled.mapInArrow(_signature_batches(parts, shorter=False), schema).alias("y")
    equal = (F.col("x.side") == EQUAL) & (F.col("y.side") == EQUAL) & (F.col("x.word") < F.col("y.word"))
    unequal = (F.col("x.side") == SHORTER) & (F.col("y.side") == LONGER)
    one_end = (F.col("x.head") == F.col("y.head")) | (F.col("x.tail") == F.col("y.tail"))
    near = F.levenshtein("x.word", "y.word", 1) == 1
    met = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & one_end & (equal | unequal) & near)
    return met.select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).distinct()


def _with_roots(forms: DataFrame, work: Staging) -> DataFrame:
    """(word, root) of words that have a form: the end of the chain of forms.

    A form occurs at least twice as often as its word, so a chain has less than 64 words and
    six doublings of the step reach its end; they stop as soon as all have. Words fill many
    times their files in memory, and broadcasts of all doublings would stay with the driver.
    """
    steps = work.table(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(6):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(onward.hint("merge"), "root", "left_semi").isEmpty():
            break
        moved = steps.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps = work.table(moved, "roots")
    return steps


def spelling_variants(
    documents: DataFrame, least_letters: int = 5, least_n: int = 3, misspell: int | None = None
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts with the form they vary.

    Words are those of ``word_counts`` that occur ``least_n`` times or more. ``n_near`` counts
    the words one edit away; the most frequent of them (of equals the first in code-point
    order) is the ``form`` if it occurs at least twice as often as the word, else ``form`` and
    ``form_n`` are null. ``root`` is the last of the chain of forms, the word itself without one.

    Null and empty texts have no words, repeated rows count as often as they are there, texts
    of any length are read whole, other columns play no part; an empty table gives no rows.
    """
    with Staging(documents.sparkSession) as work:
        counts = word_counts(documents, least_letters, misspell)
        frequent = work.table(counts.filter(F.col("n") >= least_n), "words")
        pairs = work.table(near_words(frequent), "pairs")
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(
            pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
        )
        others = frequent.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
        best = F.min(F.struct((-F.col("other_n")).alias("loss"), "other"))
        nearest = both.join(others.hint("merge"), "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
        is_form = -F.col("best.loss") >= 2 * F.col("n")
        judged = work.table(
            frequent.join(nearest.hint("merge"), "word", "left").select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(is_form, F.col("best.other")).alias("form"),
                F.when(is_form, -F.col("best.loss")).alias("form_n"),
            ),
            "forms",
        )
        roots = _with_roots(judged.filter(F.col("form").isNotNull()), work)
        found = judged.join(roots.hint("merge"), "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        )
        return stage(found, "spelling")
