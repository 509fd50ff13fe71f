"""Personal data: fixed patterns, widened by a skip-chain conditional random field.

The patterns give the base spans, which always stay. A random field over the tokens
that hold a digit or an at sign adds spans the patterns miss. Its nodes are those
tokens; neighbours in the text share a chain potential, and occurrences of the same
core anywhere in a document share a skip potential: two with each other, more through one
hub node, so a token repeated n times costs n edges and evidence reaches all repeats in
two steps. Loopy message passing until nothing changes gives the marginals, by which a
bare repetition of a value known from a telling place gets that value's label.

Training is piecewise, on a bounded sample of documents labelled by the patterns and by
key-value rules for secrets: a softmax for the tokens, pair statistics for the two kinds
of edges. All other tokens are clamped to "other" and are no nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")
#: Documents whose tokens the field is trained on.
TRAINING_DOCUMENTS = 6000
#: Marginal from which a token outside the base spans is added.
ADD_FROM = 0.9
#: Largest change of a message, in log units, at which message passing ends, and rounds in which it must.
TOLERANCE = 1e-5
MAX_ROUNDS = 5000
#: Rounds after which messages are damped twice as much.
CALMER = 500
#: Characters from which a core counts as the same thing wherever it stands.
REPEAT_CHARS = 6
BUCKETS = 1 << 12
SLICE_ROWS = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|token|secret|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_./+-]{8,})"
)
_EDGE = "()[]{}<>\"'.,;:!?*"

RESULT_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
    " spans string, n_added long"
)

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def _addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if k % 2 == 0 else (2 * value - 9 if value > 4 else 2 * value)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for run in _CARD.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", run.start(), run.end()


def _phones(text: str) -> Iterator[Span]:
    for run in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in run.group()) <= 15:
            yield "phone", run.start(), run.end()


def base_spans(text: str) -> list[Span]:
    """The pattern matches, by kind in the order of ``KINDS``, then by start."""
    spans = list(_emails(text)) if "@" in text else []
    return spans + [*_addresses(text), *_cards(text), *_phones(text)]


def printed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


class Token(NamedTuple):
    start: int
    end: int
    chained: bool  # directly after the previous node's token


def tokens(text: str) -> list[Token]:
    """The cores of the white-space tokens that hold a digit or an at sign."""
    found, last, hint = [], -2, _HINT.search(text)
    while hint:
        start = hint.start()
        while start and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, hint.end())
        end = space.start() if space else len(text)
        a, b = start, end
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            found.append(Token(a, b, 0 <= last and last + 1 >= start))
        last = end
        hint = _HINT.search(text, end)
    return found


def _shape(core: str) -> str:
    """Classes of characters, with runs shortened to at most four."""
    shape = re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", core[:64])))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", shape)


def features(text: str, token: Token) -> tuple[list[int], list[int]]:
    """Hashed features of a token itself and of the place it stands in."""
    core = text[token.start : token.end]
    digits = sum("0" <= c <= "9" for c in core)
    value = core.rpartition("=")[2]
    own = [
        f"shape {_shape(core)}",
        f"length {min(40, len(value)) // 4}",
        f"digits {min(20, digits)}",
        f"share {10 * digits // len(core)}",
        f"dots {min(5, core.count('.'))}",
        f"at {'@' in core} plus {core[0] == '+'}",
        f"hex {len(value) >= 12 and all(c in '0123456789abcdef' for c in value)}",
        f"luhn {13 <= digits <= 19 and luhn(''.join(c for c in core if '0' <= c <= '9'))}",
    ]
    before = text[max(0, token.start - 24) : token.start].split()
    place = [
        f"key {core.partition('=')[0].lower() if '=' in core else ''}",
        f"before {(before[-1] if before else '')[:12].lower()}",
        f"second {(before[-2] if len(before) > 1 else '')[:12].lower()}",
        f"open {text[max(0, token.start - 1) : token.start]}",
    ]
    place = [p for p in place if len(p) > 8 or p.startswith("open")]
    bucket = lambda name: crc32(name.encode("utf-8", "replace")) % BUCKETS
    return [bucket(f) for f in own], [bucket(f) for f in place]


def _core_key(text: str, token: Token) -> str:
    """What repeated tokens have in common: the value after a key, without separators and case."""
    return re.sub(r"[\s().\"'-]", "", text[token.start : token.end].rpartition("=")[2]).lower()


class Graph(NamedTuple):
    own: list[list[int]]
    place: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str, found: list[Token]) -> Graph:
    own, place, chain, skip, seen = [], [], [], [], {}
    for k, token in enumerate(found):
        a, b = features(text, token)
        own.append(a)
        place.append(b)
        if k and token.chained:
            chain.append((k - 1, k))
        key = _core_key(text, token)
        if key in seen:
            skip.append((seen[key], k))
        seen[key] = k
    return Graph(own, place, chain, skip)


def seed_labels(text: str, found: list[Token]) -> list[int]:
    """Labels by the patterns and the key-value rules, for training.

    Occurrences of a labelled core elsewhere in the text have its label too.
    """
    spans = base_spans(text) + [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    spans.sort(key=lambda s: s[1])
    labels, first = [], 0
    for token in found:
        while first < len(spans) and spans[first][2] <= token.start:
            first += 1
        label = 0
        for kind, start, end in spans[first : first + 4]:
            if start < token.end and end > token.start:
                label = LABELS.index(kind)
                break
        labels.append(label)
    known = {_core_key(text, t): y for t, y in zip(found, labels) if y and t.end - t.start >= REPEAT_CHARS}
    return [y or known.get(_core_key(text, t), 0) for t, y in zip(found, labels)]


class Field(NamedTuple):
    """A trained field: token weights, chain and skip potentials, log shares of the labels of repeats."""

    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hub: np.ndarray = np.zeros(len(LABELS))


def _padded(rows: list[list[int]]) -> np.ndarray:
    """Feature rows of equal width; the spare bucket ``BUCKETS`` has no weight."""
    out = np.full((len(rows), max(map(len, rows), default=1)), BUCKETS)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pair_potential(pairs: list[tuple[int, int]], agreement: float) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of joint and independent frequencies, and the log of the latter.

    ``agreement`` are prior counts of equal labels.
    """
    k = len(LABELS)
    counts = np.full((k, k), 0.5) + agreement * np.eye(k)
    for a, b in pairs:
        counts[a, b] += 1
        counts[b, a] += 1
    joint = counts / counts.sum()
    share = joint.sum(axis=1)
    return np.log(joint / np.outer(share, share)), np.log(share)


def train(rows: list[tuple[Graph, list[int]]], steps: int = 150, rate: float = 0.5) -> Field:
    """Piecewise training. Every token counts twice, with and without its surroundings."""
    k = len(LABELS)
    samples = [(o + p, y) for g, ys in rows for o, p, y in zip(g.own, g.place, ys)]
    samples += [(o, y) for g, ys in rows for o, y in zip(g.own, ys)]
    weights, bias = np.zeros((BUCKETS + 1, k)), np.zeros(k)
    bias[0] = 1.0
    if samples:
        index, target = _padded([s for s, _ in samples]), np.eye(k)[[y for _, y in samples]]
        seen = np.full((BUCKETS + 1, k), 1e-6)
        for _ in range(steps):
            error = (_softmax(weights[index].sum(axis=1) + bias) - target) / len(samples)
            gradient = np.zeros_like(weights)
            np.add.at(gradient, index.ravel(), np.repeat(error, index.shape[1], axis=0))
            gradient += 1e-6 * weights
            seen += gradient**2
            weights -= rate * gradient / np.sqrt(seen)
            weights[BUCKETS] = 0
            bias -= rate * error.sum(axis=0)
    chain = [(ys[a], ys[b]) for g, ys in rows for a, b in g.chain]
    skip = [(ys[a], ys[b]) for g, ys in rows for a, b in g.skip]
    return Field(weights, bias, _pair_potential(chain, 1.0)[0], *_pair_potential(skip, 5.0))


def _skip_edges(pairs: list[tuple[int, int]], hub: int) -> tuple[list[tuple[int, int]], int]:
    """Edges between the occurrences of each core: one for two, else one each to a hub, numbered from ``hub``.

    ``pairs`` join each occurrence with the next. The second value is the number of hubs.
    """
    groups: dict[int, list[int]] = {}
    for a, b in pairs:
        group = groups.setdefault(a, [a])
        group.append(b)
        groups[b] = group
    edges, hubs = [], 0
    for first, group in groups.items():
        if first == group[0]:
            if len(group) == 2:
                edges.append((group[0], group[1]))
            else:
                edges += [(k, hub + hubs) for k in group]
                hubs += 1
    return edges, hubs


def marginals(field: Field, graphs: list[Graph], rounds: int | None = None) -> np.ndarray:
    """Label marginals of all nodes of the graphs by damped loopy message passing.

    A graph goes on until no message changes by more than ``TOLERANCE``. Messages that
    swing are damped more every ``CALMER`` rounds; a graph that has not settled after
    ``MAX_ROUNDS`` is read as it is then. Given ``rounds``, at most as many are made.
    """
    rows = [o + p for g in graphs for o, p in zip(g.own, g.place)]
    k = len(LABELS)
    if not rows:
        return np.zeros((0, k))
    unary = field.weights[_padded(rows)].sum(axis=1) + field.bias
    chain, skip, owners, n, first = [], [], ([], []), len(rows), 0
    for number, g in enumerate(graphs):
        edges, hubs = _skip_edges([(first + a, first + b) for a, b in g.skip], n)
        chain += [(first + a, first + b) for a, b in g.chain]
        skip += edges
        owners[0].extend([number] * len(g.chain))
        owners[1].extend([number] * len(edges))
        n += hubs
        first += len(g.own)
    unary = np.concatenate((unary, np.tile(field.hub, (n - len(rows), 1))))
    unary -= unary.max(axis=1, keepdims=True)
    if not chain and not skip:
        return _softmax(unary)
    pairs = np.array(chain + skip)
    source, target = np.concatenate((pairs[:, 0], pairs[:, 1])), np.concatenate((pairs[:, 1], pairs[:, 0]))
    reverse = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))
    of_skip = np.tile(np.arange(len(pairs)) >= len(chain), 2)
    owner = np.tile(np.array(owners[0] + owners[1]), 2)
    potential = np.stack((field.chain, field.skip))
    potential = (np.exp(potential - potential.max(axis=(1, 2), keepdims=True)))[of_skip.astype(int)]
    messages = np.zeros((len(source), k))
    # edges of the graphs that still change
    live = np.arange(len(source))
    for done in range(MAX_ROUNDS if rounds is None else rounds):
        belief = unary.copy()
        for label in range(k):
            belief[:, label] += np.bincount(target[live], messages[live, label], minlength=n)
        given = belief[source[live]] - messages[reverse[live]]
        given = np.exp(given - given.max(axis=1, keepdims=True))
        sent = np.log(np.einsum("ea,eab->eb", given, potential[live]))
        sent -= sent.max(axis=1, keepdims=True)
        change = np.abs(sent - messages[live]).max(axis=1)
        step = 0.5 ** (1 + done // CALMER)
        messages[live] = (1 - step) * messages[live] + step * sent
        going = np.zeros(len(graphs), dtype=bool)
        going[owner[live][change > TOLERANCE]] = True
        live = live[going[owner[live]]]
        if not len(live):
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return _softmax(belief[: len(rows)])


def found_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    nodes = [tokens(t) for t in texts]
    graphs = [graph(t, n) for t, n in zip(texts, nodes)]
    sure = marginals(field, graphs)
    out, at = [], 0
    for text, spans, own in zip(texts, base, nodes):
        added = []
        if own:
            own_sure = sure[at : at + len(own)]
            best = own_sure.argmax(axis=1)
            taken = sorted(spans, key=lambda s: s[1])
            starts = [s[1] for s in taken]
            reach = np.maximum.accumulate([s[2] for s in taken]) if taken else []
            for k in np.flatnonzero((best > 0) & (own_sure.max(axis=1) >= ADD_FROM)):
                token = own[k]
                start = token.start + text[token.start : token.end].rfind("=") + 1
                # the last base span that begins before the token's end
                before = int(np.searchsorted(starts, token.end)) - 1
                if start < token.end and (before < 0 or reach[before] <= start):
                    added.append((LABELS[best[k]], start, token.end))
        at += len(own)
        out.append((spans, added))
    return out


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["own", "place", "chain", "skip", "labels"]
    nested = pa.list_(pa.list_(pa.int32()))
    kinds = [nested, nested, nested, nested, pa.list_(pa.int32())]
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            found = tokens(text)
            if found:
                g = graph(text, found)
                row = [g.own, g.place, [list(p) for p in g.chain], [list(p) for p in g.skip], seed_labels(text, found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value], kind) for value, kind in zip(row, kinds)], names=names
                )


def trained_field(documents: DataFrame, sample: int = TRAINING_DOCUMENTS) -> Field:
    """A field trained on the ``sample`` documents of smallest id hash.

    Only token features, not texts, of that fixed number of documents reach the driver.
    """
    ids = (
        documents.select("doc_id")
        .filter(F.col("doc_id").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    nested = "array<array<int>>"
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .select("text")
        .mapInArrow(
            _training_batches,
            f"own {nested}, place {nested}, chain {nested}, skip {nested}, labels array<int>",
        )
        .collect()
    )
    rows.sort(key=lambda r: (len(r["own"]), str(r["own"][0])))
    return train(
        [
            (Graph(r["own"], r["place"], [tuple(p) for p in r["chain"]], [tuple(p) for p in r["skip"]]), r["labels"])
            for r in rows
        ]
    )


def _result_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                found = found_spans(field, [t or "" for t in part.column(1).to_pylist()])
                counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
                order = {kind: n for n, kind in enumerate(LABELS)}
                every = [sorted(base + added, key=lambda s: (order[s[0]], s[1])) for base, added in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(printed(base).encode()).hexdigest() for base, _ in found]),
                        pa.array([printed(spans) for spans in every]),
                        pa.array([len(added) for _, added in found], pa.int64()),
                    ],
                    names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_added"],
                )

    return run


def personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data of every row: counts and digest of the base spans, and all spans.

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): spans are
    ``kind:start:end`` in code points, by kind, then start; counts and digest are of the
    base spans. Null and empty texts have no span; repeated rows are judged one by one;
    null ids stay null. Other columns play no part, an empty table gives no rows.
    """
    field = field or trained_field(documents)
    shared = documents.sparkSession.sparkContext.broadcast(field)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_result_batches(shared), RESULT_SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by ``[KIND]``; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _masked_batches(shared, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                texts = part.column(place).to_pylist()
                found = found_spans(field, [t or "" for t in texts])
                new = [None if t is None else mask(t, b + a) for t, (b, a) in zip(texts, found)]
                columns = part.columns
                columns[place] = pa.array(new, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return run


def masked(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced by ``[KIND]``, and ``n_chars`` to match.

    Every row stays; null texts stay null.
    """
    field = field or trained_field(documents)
    shared = documents.sparkSession.sparkContext.broadcast(field)
    place = documents.columns.index("text")
    out = documents.mapInArrow(_masked_batches(shared, place), documents.schema)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return out.select(*documents.columns)
