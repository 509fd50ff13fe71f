"""Repair of conversation structure: a run-length DP over min-plus transitions.

A conversation is well formed if the initials of its roles give ``(s?(ua)+)?``. Edits keep,
rerole or delete a row or insert an empty one; the cheapest edits are wanted. A row matters
only by its symbol: whether it may stay, whether it is truncated, and its role's initial. There
are nine symbols and four states (nothing yet, after s, after u, after a), so a symbol is a
4 x 4 matrix of least costs, and a run of equal symbols is a power of it under (min, +), put
together from cached binary powers. From the costs behind every run the choices are unrolled
forwards, the first letter of D, I, K, R that is on a cheapest way: that is the ASCII-least audit.

A conversation may hold a great part of the table, so none is gathered:

1. the rows are sorted over the whole table, a conversation being spread over as many
   partitions as it fills, and keep their place as ``pos``;
2. repeats of (role, text) are found by grouping, with map-side aggregation;
3. each partition reads its rows as symbols, a byte each. Conversations inside of it are solved
   there; the pieces of those that reach over its ends, at most two a partition, become matrices;
4. over the pieces of a conversation costs are carried backwards, choices forwards;
5. rows stream past their edits in order, into the repaired rows or their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import stage
from shelfwise.sources.sinks import Staging

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

_WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
_START, _S, _U, _A = range(4)
#: The state after the role that may come next by an insertion or a new role, by state.
_NEXT = (_U, _U, _A, _U)
#: Role initials as numbers; others are 3.
_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
#: Symbols: initial, plus 4 if truncated; 8 must be deleted.
_MUST_GO = 8

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _row_options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what can be done with a row, in ASCII order."""
    options = [("D", DELETE, state)]
    if symbol == _MUST_GO:
        return options
    initial, extra = symbol % 4, TRUNCATED if symbol >= 4 else 0
    after = _NEXT[state]
    if initial == 0 and state == _START:
        options.append(("K", extra, _S))
    elif (initial, after) in ((1, _U), (2, _A)):
        options.append(("K", extra, after))
    options.append(("R", REROLE + extra, after))
    return options


def _times(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(min(x[i][k] + y[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _applied(x: Matrix, v: Vector) -> Vector:
    return tuple(min(x[i][0] + v[0], x[i][1] + v[1], x[i][2] + v[2], x[i][3] + v[3]) for i in range(4))


def _inserted() -> Matrix:
    """Least costs of getting from state to state by insertions."""
    once = [[0 if i == j else _FAR for j in range(4)] for i in range(4)]
    for i in range(4):
        once[i][_NEXT[i]] = min(once[i][_NEXT[i]], INSERT)
    matrix = tuple(map(tuple, once))
    return _times(matrix, matrix)


_INSERTED = _inserted()
_UNIT: Matrix = tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))
#: Costs of ending, by state.
_END: Vector = _applied(_INSERTED, (0, _FAR, _FAR, 0))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition over ``2 ** k`` rows of a symbol, insertions before each row included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in _row_options(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return _times(_INSERTED, tuple(map(tuple, row)))


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    if not symbols:
        return []
    values = np.frombuffer(symbols, dtype=np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return list(zip(values[starts].tolist(), np.diff(np.append(starts, len(values))).tolist()))


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def transition(runs: list[tuple[int, int]]) -> Matrix:
    """The transition over all runs."""
    out = _UNIT
    for symbol, length in runs:
        for k in _bits(length):
            out = _times(out, power(symbol, k))
    return out


def unrolled(runs: list[tuple[int, int]], after: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """(audit, cost, state at the end): the choices over the runs from a state.

    ``after`` holds the least costs of what comes behind the runs; with ``last`` that is the
    end of the conversation, where insertions may follow. The cost is that of the rest from here.
    """
    behind = [after]
    for symbol, length in reversed(runs):
        v = behind[-1]
        for k in _bits(length):
            v = _applied(power(symbol, k), v)
        behind.append(v)
    behind.reverse()
    cost, audit = behind[0][state], []
    for at, (symbol, length) in enumerate(runs):
        costs = [behind[at + 1]]
        for _ in range(length):
            costs.append(_applied(power(symbol, 0), costs[-1]))
        for left in range(length, 0, -1):
            here, onward = costs[left], costs[left - 1]
            consumed = False
            while not consumed:
                letter, state, consumed = _choice(symbol, state, here, onward)
                audit.append(letter)
    while last and state not in (_START, _A):
        audit.append("I")
        state = _NEXT[state]
    return "".join(audit), cost, state


def _choice(symbol: int, state: int, here: Vector, onward: Vector) -> tuple[str, int, bool]:
    """The first letter on a cheapest way, the state after it, and whether it uses up the row."""
    for letter, price, after in _row_options(symbol, state):
        if letter > "I" and INSERT + here[_NEXT[state]] == here[state]:
            break
        if price + onward[after] == here[state]:
            return letter, after, True
    return "I", _NEXT[state], False


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its
    role user. A null counts as one space, in the checksum as in role and text. Rows of equal
    conv_id and turn meet the same fate.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 0, F.array().cast("array<int>")).when(
        F.col("fate") == 3, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return (
        conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), fate.alias("fate"))
        .withColumns({"text": text, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))})
        .select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))
        .drop("copy")
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in order over the whole table, with place, partition and what the symbol needs."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"))
    visible = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(initial == c, k) for c, k in _INITIALS.items()), F.lit(_OTHER))
    return (
        plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(
            "*",
            F.monotonically_increasing_id().alias("pos"),
            F.spark_partition_id().alias("part"),
            # a conversation's key: unlike its id never null, and a number
            F.xxhash64("conv_id", F.col("conv_id").isNull()).alias("conv"),
            initial.alias("initial"),
            (visible == "").alias("blank"),
            (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
            F.xxhash64("conv_id", "role", "text").alias("same_a"),
            F.xxhash64(F.lit(1), F.col("text"), F.col("role"), F.col("conv_id")).alias("same_b"),
        )
    )


def _repeats(placed: DataFrame) -> DataFrame:
    """(pos) of rows whose role and text the conversation has had before; blank ones aside."""
    rows = placed.filter(~F.col("blank")).select("same_a", "same_b", "pos")
    firsts = rows.groupBy("same_a", "same_b").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    several = firsts.filter(F.col("n") > 1).drop("n")
    return rows.join(several, ["same_a", "same_b"]).filter(F.col("pos") > F.col("first")).select("pos")


class Piece(NamedTuple):
    """The rows of one conversation in one partition."""

    conv: int
    part: int
    pos: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first_initial: int
    last_initial: int
    first_turn: int | None
    last_turn: int | None
    turns: int
    symbols: bytes


_NUMBERS = (
    "conv long, part int, pos long, blank long, duplicate long, truncated long, illegal long,"
    " first_initial int, last_initial int, first_turn long, last_turn long, turns long"
)
_PIECE_SCHEMA = f"{_NUMBERS}, symbols binary, matrix array<long>, audit string, cost long"
_HEAD_SCHEMA = f"{_NUMBERS}, audit string, cost long"
_SYMBOL_COLUMNS = ("conv", "part", "pos", "turn", "has_turn", "initial", "blank", "duplicate", "truncated")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(field.split() for field in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _piece(columns: list[np.ndarray]) -> Piece:
    conv, part, pos, turn, has_turn, initial, blank, duplicate, truncated = columns
    duplicate = duplicate & ~blank
    truncated = truncated & ~blank & ~duplicate
    symbols = np.where(blank | duplicate, _MUST_GO, initial + 4 * truncated).astype(np.uint8)
    a, b = initial[:-1], initial[1:]
    legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    turns = turn[has_turn]
    return Piece(
        int(conv[0]), int(part[0]), int(pos[0]),
        int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), int((~legal).sum()),
        int(initial[0]), int(initial[-1]),
        int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None,
        int((turns[1:] != turns[:-1]).sum()) + 1 if len(turns) else 0,
        symbols.tobytes(),
    )


def _solved(piece: Piece, inner: bool) -> tuple:
    runs = runs_of(piece.symbols)
    if inner:
        audit, cost, _ = unrolled(runs, _END, _START, True)
        return (*piece[:-1], None, None, audit, cost)
    return (*piece, [c for line in transition(runs) for c in line], None, None)


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every piece; inner ones of a partition are whole conversations and come solved."""
    held: list[list[np.ndarray]] = []  # the open piece, in slices of batches
    closed: tuple[Piece, bool] | None = None  # the piece before it, and whether its part has one before that
    ready: list[tuple] = []

    def close() -> None:
        nonlocal closed
        piece = _piece([np.concatenate(c) for c in zip(*held)])
        held.clear()
        same_part = closed is not None and closed[0].part == piece.part
        if closed is not None:
            ready.append(_solved(closed[0], closed[1] and same_part))
        closed = (piece, same_part)

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        conv, part = columns[:2]
        changes = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
        for piece in zip(*(np.split(c, changes) for c in columns)) if batch.num_rows else ():
            if held and (held[-1][0][0] != piece[0][0] or held[-1][1][0] != piece[1][0]):
                close()
            held.append(piece)
        if len(ready) >= 5000:
            yield _batch(ready, _PIECE_SCHEMA)
            ready.clear()
    if held:
        close()
        ready.append(_solved(closed[0], False))
    yield _batch(ready, _PIECE_SCHEMA)


_WAYS_SCHEMA = f"{_NUMBERS}, audits array<string>, costs array<long>, ends array<long>"


def _backward_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first of a conversation: what to do in each from every state."""
    conv, behind, last = None, _END, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                conv, behind, last = row["conv"], _END, True
            runs = runs_of(row["symbols"])
            ways = [unrolled(runs, behind, state, last) for state in range(4)]
            out.append((*(row[n] for n in Piece._fields[:-1]), *map(list, zip(*ways))))
            matrix = row["matrix"]
            behind, last = _applied(tuple(tuple(matrix[4 * i : 4 * i + 4]) for i in range(4)), behind), False
        kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        heads = _batch([r[:12] for r in out], _NUMBERS)
        more = [pa.array([r[12 + k] for r in out], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*heads.columns, *more], names=[*heads.schema.names, "audits", "costs", "ends"])


def _forward_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the first to the last of a conversation, with the audit of the state each begins in."""
    conv, state = None, _START
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            cost = 0
            if row["conv"] != conv:
                conv, state = row["conv"], _START
                cost = row["costs"][_START]
            out.append((*(row[n] for n in Piece._fields[:-1]), row["audits"][state], cost))
            state = row["ends"][state]
        yield _batch(out, _HEAD_SCHEMA)


def _heads(placed: DataFrame, work: Staging) -> DataFrame:
    """Pieces with their audits. The cost of a conversation is that of its first piece."""
    repeats = _repeats(placed).withColumn("duplicate", F.lit(True))
    symbols = placed.join(repeats, "pos", "left").select(
        "conv", "part", "pos", F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"), "initial", "blank",
        F.coalesce("duplicate", F.lit(False)).alias("duplicate"), "truncated",
    )
    ordered = symbols.select(*_SYMBOL_COLUMNS).repartition("part").sortWithinPartitions("pos")
    pieces = work.table(ordered.mapInArrow(_piece_batches, _PIECE_SCHEMA), "pieces")
    over_ends = pieces.filter(F.col("matrix").isNotNull())
    backward = over_ends.repartition("conv").sortWithinPartitions("conv", F.desc("part"))
    ways = backward.mapInArrow(_backward_batches, _WAYS_SCHEMA)
    forward = ways.repartition("conv").sortWithinPartitions("conv", "part")
    names = _batch([], _HEAD_SCHEMA).schema.names
    inner = pieces.filter(F.col("matrix").isNull()).select(*names)
    return work.table(inner.unionByName(forward.mapInArrow(_forward_batches, _HEAD_SCHEMA)), "heads")


class _Conversation:
    """Sums over the pieces of a conversation, and its rows as they come out of the edits."""

    def __init__(self, conv_id: object, write: Callable[[str | None, str, str, int | None], None]) -> None:
        self.conv_id, self.write = conv_id, write
        self.state, self.edits, self.audit = _START, iter(()), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.last_initial = None

    def piece(self, head: dict) -> None:
        self.finish()
        for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
            setattr(self, name, getattr(self, name) + head[name])
        if self.last_initial is not None:
            self.illegal += (self.last_initial, head["first_initial"]) not in _LEGAL
        self.last_initial = head["last_initial"]
        if head["first_turn"] is not None:
            if self.low is None:
                self.low = head["first_turn"]
            elif self.high == head["first_turn"]:
                self.turns -= 1
            self.high = head["last_turn"]
        self.audit.append(head["audit"])
        self.edits = iter(head["audit"])

    def _insert(self) -> None:
        self.state = _NEXT[self.state]
        self.write("I", ROLES["u" if self.state == _U else "a"], "", None)

    def row(self, role: str, text: str, turn: int | None) -> None:
        edit = next(self.edits)
        while edit == "I":
            self._insert()
            edit = next(self.edits)
        if edit == "D":
            return
        self.state = _S if edit == "K" and role[0] == "s" else _NEXT[self.state]
        self.write(edit, role if edit == "K" else ROLES["u" if self.state == _U else "a"], text, turn)

    def finish(self) -> None:
        for _ in self.edits:
            self._insert()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_STREAM = ["conv", "pos", "kind", "turn", "role", "text", "head"]
_DIGEST_SCHEMA = (
    "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_REPAIRED_SCHEMA = "conv long, place long, turn long, role string, text string, edit string"
_ROWS_AT_ONCE = 2000


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation; its rows stream through a hash and are not kept."""
    out: list[tuple] = []
    now: _Conversation | None = None
    digest, empty = hashlib.sha256(), True

    def write(_: str, role: str, text: str, __: int | None) -> None:
        nonlocal empty
        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False

    def done() -> None:
        now.finish()
        numbers = (now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, now.cost)
        out.append((now.conv_id, *numbers, "".join(now.audit), digest.hexdigest()))

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv_id:
                if now is not None:
                    done()
                digest, empty = hashlib.sha256(), True
                now = _Conversation(row["conv"], write)
            if row["kind"] == 0:
                now.piece(row["head"])
            else:
                now.row(row["role"], row["text"], row["turn"])
        if len(out) >= _ROWS_AT_ONCE:
            yield _batch(out, _DIGEST_SCHEMA)
            out.clear()
    if now is not None:
        done()
    yield _batch(out, _DIGEST_SCHEMA)


def _repaired_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now: _Conversation | None = None
    place = 0

    def write(edit: str, role: str, text: str, turn: int | None) -> None:
        nonlocal place
        place += 1
        out.append((now.conv_id, place, turn, role, text, edit))

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv_id:
                if now is not None:
                    now.finish()
                now, place = _Conversation(row["conv"], write), 0
            if row["kind"] == 0:
                now.piece(row["head"])
            else:
                now.row(row["role"], row["text"], row["turn"])
            if len(out) >= _ROWS_AT_ONCE:
                yield _batch(out, _REPAIRED_SCHEMA)
                out.clear()
    if now is not None:
        now.finish()
    yield _batch(out, _REPAIRED_SCHEMA)


def _streamed(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """Every conversation's pieces and rows in order, each piece before its first row."""
    head = F.struct(*(c for c in heads.columns if c not in ("conv", "part", "pos")))
    nothing = lambda kind: F.lit(None).cast(kind)
    first = heads.select(
        "conv", "pos", F.lit(0).alias("kind"), nothing("long").alias("turn"), nothing("string").alias("role"),
        nothing("string").alias("text"), head.alias("head"),
    )
    rows = placed.select(
        "conv", "pos", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text",
        nothing(first.schema["head"].dataType).alias("head"),
    )
    return first.union(rows).select(*_STREAM).repartition("conv").sortWithinPartitions("conv", "pos", "kind")


def _named(found: DataFrame, placed: DataFrame) -> DataFrame:
    """With the conversation's id in place of its key."""
    names = placed.select("conv", "conv_id").groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    return names.join(found, "conv").select("conv_id", *(c for c in found.columns if c != "conv"))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows of the repaired conversations.

    ``place`` counts from 1; ``edit`` is K (kept), R (new role) or I (inserted, with an empty
    text and no turn). Conversations of which nothing is left have no row. The rules are those
    of ``audits``.
    """
    with Staging(conversations.sparkSession) as work:
        placed = work.table(_placed(conversations), "rows")
        rows = _streamed(placed, _heads(placed, work)).mapInArrow(_repaired_batches, _REPAIRED_SCHEMA)
        return stage(_named(rows, placed), "repaired")


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    Rows are taken by turn, nulls first, and by role and text where turns are equal. The first
    fault of a row counts: blank (nothing but ASCII white space), duplicate (role and text seen
    earlier in the conversation), truncated (the last visible character is none of ``.!?``).
    ``gaps`` is the number of turns missing between the first and the last, ``illegal`` that of
    neighbouring rows whose role initials are not su, ua or au. Blank and duplicate rows have to
    be deleted. ``audit`` has the letters of the cheapest edits in order, of equally cheap ones
    the ASCII-least; the digest is that of the repaired ``role:text`` lines.

    A null role or text is one space. A null conv_id is a conversation of its own. A role that
    begins with another letter, or is empty, can only be replaced or deleted. Repeated rows are
    duplicates. Texts of any length stream through; a conversation may fill any number of
    partitions up to the last step, where one task reads its rows in order without keeping them,
    as a digest has to. Other columns play no part; an empty table gives no rows.
    """
    with Staging(conversations.sparkSession) as work:
        placed = work.table(_placed(conversations), "rows")
        found = _streamed(placed, _heads(placed, work)).mapInArrow(_digest_batches, _DIGEST_SCHEMA)
        return stage(_named(found, placed), "audits")


def structure(conversations: DataFrame) -> DataFrame:
    """``audits`` of the damaged conversations, with a row of zeros, an empty audit and the digest
    of nothing for those that lost all their rows."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = audits(damaged(conversations))
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    defaults: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    rest = [c for c in found.columns if c != "conv_id"]
    return joined.select(
        F.col("_id").alias("conv_id"), *(F.coalesce(c, defaults.get(c, F.lit(0).cast("long"))).alias(c) for c in rest)
    )
