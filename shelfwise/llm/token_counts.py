"""Token counts by scanning flat token files for end-of-document identifiers.

A flat token file is a run of fixed-width token ids with no index; a document ends at a
separator id. Files are cut into blocks without regard to documents. A vectorised search
finds the separators of each block; a prefix scan over the blocks' summaries then tells
how many tokens of an open document each block begins with, and how many documents came
before. The scan has two levels, within runs of blocks and over the runs of a file, so a
file of any size is no single task's work.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage

BLOCK_TOKENS = 1 << 18
RUN_BLOCKS = 256
SLICE_ROWS = 256

# Fixed values of the public vocabulary: its free id, and the pattern it was made with.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the pattern has it, and the length from which a run of it is cut off by hand.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 2000
_LONG_RUNS = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")

BLOCK_SCHEMA = "file string, block long, payload binary, doc_ids array<long>"
SUMMARY_SCHEMA = "file string, block long, n_separators long, head long, tail long, inside array<int>, doc_ids array<long>"

Batches = Iterator[pa.RecordBatch]


def _ids(encoding, text: str) -> list[int]:
    """The token ids of a text.

    The encoder's pattern runs out of stack on very long runs of white space. Such a run is
    one piece of the pattern, but for its last character where text follows, and pieces are
    encoded one by one: so is this one, and the text before and behind it.
    """
    out, begin = [], 0
    for run in _LONG_RUNS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[begin : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end].encode())
        begin = end
    return out + encoding.encode_ordinary(text[begin:])


def _encoded_batches(shared, pattern: str, separator: int, block_tokens: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file = f"part-{TaskContext.get().partitionId():05d}"
        parts, held, ids, number = [], 0, [], 0

        def block(payload: np.ndarray, own: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file]),
                    pa.array([number], pa.int64()),
                    pa.array([payload.astype("<u2").tobytes()], pa.binary()),
                    pa.array([own], pa.list_(pa.int64())),
                ],
                names=["file", "block", "payload", "doc_ids"],
            )

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = np.array(_ids(encoding, text or "") + [separator], dtype=np.uint16)
                    parts.append(tokens)
                    held += len(tokens)
                    ids.append((doc_id, held))
                    if held >= block_tokens:
                        joined = np.concatenate(parts)
                        whole = held // block_tokens * block_tokens
                        for first in range(0, whole, block_tokens):
                            end = first + block_tokens
                            yield block(joined[first:end], [i for i, at in ids if first < at <= end])
                            number += 1
                        parts, held = [joined[whole:]], held - whole
                        ids = [(i, at - whole) for i, at in ids if at > whole]
        if held:
            yield block(np.concatenate(parts), [i for i, _ in ids])

    return run


def flat_files(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    pattern: str = WORD_PATTERN,
    separator: int = SEPARATOR,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Documents as flat token files of 16-bit ids, one file a task, in blocks.

    (file, block, payload, doc_ids): the payloads of a file, in order, are its bytes;
    ``doc_ids`` names the documents that end in the block and says nothing of where. The
    vocabulary is a local file of the driver and travels to the tasks as a broadcast.
    """
    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_encoded_batches(shared, pattern, separator, block_tokens), BLOCK_SCHEMA)


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks of binary token files in any store that Spark reads; files of up to 2 GB.

    ``block_bytes`` must be a multiple of the token width.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    n_blocks = F.ceil(F.col("length") / block_bytes).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda k: F.struct(
            k.cast("long").alias("block"),
            F.substring(F.col("content"), k * block_bytes + 1, F.lit(block_bytes)).alias("payload"),
        ),
    )
    return files.select(F.col("path").alias("file"), F.explode(pieces).alias("p")).select(
        "file", "p.block", "p.payload", F.lit(None).cast("array<long>").alias("doc_ids")
    )


def _summary_batches(separator: int, width: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            n_found, heads, tails, inside = [], [], [], []
            for payload in batch.column("payload"):
                raw = payload.as_py() or b""
                size = np.dtype(width).itemsize
                tokens = np.frombuffer(raw, dtype=width, count=len(raw) // size)
                ends = np.flatnonzero(tokens == separator)
                n_found.append(len(ends))
                heads.append(int(ends[0]) if len(ends) else 0)
                tails.append(len(tokens) - int(ends[-1]) - 1 if len(ends) else len(tokens))
                inside.append((np.diff(ends) - 1).tolist())
            longs = [pa.array(v, pa.int64()) for v in (n_found, heads, tails)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file"),
                    batch.column("block"),
                    *longs,
                    pa.array(inside, pa.list_(pa.int32())),
                    batch.column("doc_ids"),
                ],
                names=["file", "block", "n_separators", "head", "tail", "inside", "doc_ids"],
            )

    return run


def _open_tokens(order: Window) -> Column:
    """Tokens since the last separator, after each row of ``order``.

    The sum of all tails so far, less that sum as it was before the tail of the last row
    with a separator; as the sums never fall, that is the greatest of them.
    """
    whole = F.sum("tail").over(order)
    return whole - F.coalesce(F.max(F.when(F.col("n_separators") > 0, F.col("before"))).over(order), F.lit(0))


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, width: str = "<u2") -> DataFrame:
    """(file, ordinal, doc_id, n_tokens, ended): the documents of flat files, in file order.

    ``ordinal`` counts from 0 within a file; the separator is not counted. A file that
    does not end with a separator has one more document with ``ended`` false. Two
    separators in a row enclose a document of no tokens. ``doc_id`` is known if the blocks
    say which documents end in them. Bytes that do not fill a token at the end of a block
    are ignored; blocks without payload hold nothing; no blocks give no rows.
    """
    own = blocks.select("file", F.col("block").cast("long").alias("block"), "payload", "doc_ids")
    found = own.mapInArrow(_summary_batches(separator, width), SUMMARY_SCHEMA)
    found = stage(found.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS)), "block-summaries")

    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    scanned = (
        found.withColumn("before", F.coalesce(F.sum("tail").over(earlier), zero))
        .withColumn("open", _open_tokens(inner))
        .withColumn("seen", F.coalesce(F.sum("n_separators").over(earlier), zero))
        .withColumn("carried", F.coalesce(F.last("open").over(earlier), zero))
    )
    runs = scanned.groupBy("file", "run").agg(
        F.max_by("open", "block").alias("tail"),
        F.sum("n_separators").alias("n_separators"),
        F.max("block").alias("last_block"),
    )
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    over_earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        runs.withColumn("before", F.coalesce(F.sum("tail").over(over_earlier), zero))
        .withColumn("run_open", _open_tokens(over))
        .select(
            "file",
            "run",
            F.coalesce(F.last("run_open").over(over_earlier), zero).alias("run_carried"),
            F.coalesce(F.sum("n_separators").over(over_earlier), zero).alias("run_seen"),
            (F.col("run") == F.max("run").over(Window.partitionBy("file"))).alias("last_run"),
            "last_block",
            "run_open",
        )
    )
    both = scanned.join(carried, ["file", "run"])
    first = F.col("carried") + F.when(F.col("seen") == 0, F.col("run_carried")).otherwise(zero) + F.col("head")
    lengths = F.when(
        F.col("n_separators") > 0, F.concat(F.array(first), F.col("inside").cast("array<long>"))
    ).otherwise(F.array().cast("array<long>"))
    left_over = F.col("last_run") & (F.col("block") == F.col("last_block")) & (F.col("run_open") > 0)
    ended = F.transform(
        lengths,
        lambda n, k: F.struct(
            (F.col("run_seen") + F.col("seen") + k).alias("ordinal"),
            F.get(F.col("doc_ids"), k).alias("doc_id"),
            n.alias("n_tokens"),
            F.lit(True).alias("ended"),
        ),
    )
    rest = F.array(
        F.struct(
            (F.col("run_seen") + F.col("seen") + F.col("n_separators")).alias("ordinal"),
            F.lit(None).cast("long").alias("doc_id"),
            F.col("run_open").alias("n_tokens"),
            F.lit(False).alias("ended"),
        )
    )
    return both.select("file", F.explode(F.when(left_over, F.concat(ended, rest)).otherwise(ended)).alias("d")).select(
        "file", "d.ordinal", "d.doc_id", "d.n_tokens", "d.ended"
    )


def document_token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document row, by way of flat token files in the shared folder.

    Null and empty texts have no tokens; null and repeated ids pass through.
    """
    blocks = stage(flat_files(documents, vocabulary), "flat-tokens")
    return token_counts(blocks).select("doc_id", "n_tokens")
