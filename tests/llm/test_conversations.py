from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm import conversations as op
from shelfwise.llm.shipping import ship

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)

    def build(rows, **more):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        return frame.withColumns(more) if more else frame

    return build


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def undamaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


def brute(rows):
    """The audit row of one conversation, by a plain DP over whole (cost, audit, lines)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        visible = text.rstrip(WHITE)
        faults.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, lines) in list(states.items()):
                new = (cost + 3, audit + "I", lines + (NAMES[NEXT[state]] + ":",))
                states[NEXT[state]] = min(states.get(NEXT[state], new), new, key=lambda v: v[:2])
        return states

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            options = [(state, 4, "D", ())]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if role[:1] == NEXT[state] or (role[:1] == "s" and not state):
                    options.append((role[:1], more, "K", (f"{role}:{text}",)))
                options.append((NEXT[state], 3 + more, "R", (f"{NAMES[NEXT[state]]}:{text}",)))
            for then, price, letter, line in options:
                new = (cost + price, audit + letter, lines + line)
                after[then] = min(after.get(then, new), new, key=lambda v: v[:2])
        best = after
    ends = inserted(best)
    cost, audit, lines = min((ends[s] for s in ("", "a") if s in ends), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal,
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }, lines


def by_conversation(found):
    rows = [r.asDict() for r in found.collect()]
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r.pop("conv_id"): r for r in rows}


def conversations(seed, n=60, longest=25):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ends with space. ", "newline.\n", "Été?", "a:b|c."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rng.choice(texts + [None]) if rng.random() < 0.5 else f"{rng.random()}."
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_plain_dp(table, seed):
    rows = conversations(seed)
    assert by_conversation(op.audits(table(rows))) == {c: brute(r)[0] for c, r in undamaged(rows).items()}


def test_damage_and_whole_conversations(table):
    rows = conversations(4, 120, 4)
    assert by_conversation(op.structure(table(rows))) == {c: brute(r)[0] for c, r in damage(rows).items()}


def test_all_short_conversations():
    """Every sequence of up to five symbols, by its runs, against the plain DP."""
    texts = {"s": ("system", "x{}."), "u": ("user", "x{}."), "a": ("assistant", "x{}."), "t": ("user", "x{}"), "b": ("user", " ")}
    numbers = {"s": 0, "u": 1, "a": 2, "t": 5, "b": 8}
    for n in range(6):
        for letters in itertools.product(texts, repeat=n):
            rows = [(k, texts[c][0], texts[c][1].format(k)) for k, c in enumerate(letters)]
            runs = op.runs_of(bytes(numbers[c] for c in letters))
            audit, cost, _ = op.unrolled(runs, op._END, 0, True)
            expected = brute(rows)[0]
            assert (audit, cost) == (expected["audit"], expected["cost"]), letters


def test_transitions_are_powers_of_their_runs():
    rng = random.Random(5)
    for _ in range(200):
        runs = [(rng.randrange(9), rng.randint(1, 70)) for _ in range(rng.randint(1, 5))]
        plain = op._UNIT
        for symbol, length in runs:
            for _ in range(length):
                plain = op._times(plain, op.power(symbol, 0))
        assert op.transition(runs) == plain


def test_one_conversation_over_many_partitions(spark, table):
    """Its pieces are put together again, wherever the partitions end."""
    rows = [(7, *r[1:]) for r in conversations(6, 30, 30)] + conversations(7, 5, 3)
    expected = {c: brute(r)[0] for c, r in undamaged(rows).items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert by_conversation(op.audits(table(rows))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_are_those_of_the_digest(table):
    rows = conversations(8)
    found = defaultdict(list)
    for r in op.repaired(table(rows)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(found[r["conv_id"]]) + 1
        found[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert dict(found) == {c: list(lines) for c, r in undamaged(rows).items() if (lines := brute(r)[1])}


def test_long_runs_and_very_long_texts(table):
    rows = [(1, k, "user", f"{k}.") for k in range(3000)] + [(1, 3000 + k, "user", " ") for k in range(2000)]
    rows += [(2, 0, "user", "long " * 400_000 + "."), (2, 1, "assistant", "no end " * 100_000)]
    assert by_conversation(op.audits(table(rows))) == {c: brute(r)[0] for c, r in undamaged(rows).items()}


def test_conversations_that_lose_all_rows(table):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = by_conversation(op.structure(table([(gone, 0, "user", "Hi.")])))
    zeros = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    assert found == {gone: zeros | {"audit": "", "repaired_sha256": EMPTY}}


def test_clashing_columns_repeated_rows_and_an_empty_table(table, clashing):
    rows = conversations(9, 10) * 2
    more = {name: F.lit(1) for name in [*clashing, "conv", "pos", "head", "initial", "audit", "cost", "kind"]}
    assert by_conversation(op.audits(table(rows, **more))) == {c: brute(r)[0] for c, r in undamaged(rows).items()}
    assert op.structure(table([])).collect() == [] and op.repaired(table([])).collect() == []
