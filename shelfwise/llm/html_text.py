"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's element tree are content or not. Each has a potential by its tag,
class words, text, links and place, and each edge from a parent to a child one by the
two labels. Sum-product messages go up the tree once and down once, which is exact on a
tree; an element whose marginal says "content" contributes its text.

The model is trained on labelled pages: a bounded sample of the given pages, labelled
by the element that marks the article where a page has one, and the small labelled pages
below, which show what such pages lack (sidebars, notices, forms, reader comments).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from math import exp
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 300
BUCKETS = 1 << 12
SLICE_ROWS = 64

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without readable text of the page itself.
SILENT = frozenset(
    "script style head title noscript template iframe object svg math canvas audio video map textarea select option button datalist".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul caption".split()
)
#: What an opening tag closes if it is open, and where the search for it stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
}
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
RAW = ("script", "style", "textarea", "title")
P_STOPS = ("table", "td", "th", "li", "div", "article", "section", "main", "body", "blockquote", "button")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAME_WORD = re.compile(r"[A-Za-z]+")

PAGE_SCHEMA = "page_id long, url string, text string, n_chars long"

#: Labelled pages: elements with ``data-content`` are the article, but for those with
#: ``data-other`` inside it; all others are not.
LABELLED_PAGES = [
    """<body><header><a href="/">Home</a><p>The daily reader</p></header><div class="wrap"><aside class="sidebar">
    <h3>Related</h3><ul><li><a href="/a">First story</a></li><li><a href="/b">Second story</a></li></ul></aside>
    <main data-content><h1>Bridges of the north</h1><p>The first bridge was built of timber, and it stood for a century.</p>
    <p>Its successor, of stone, still carries the road today.</p></main></div><section class="comments" id="comments">
    <h2>Comments</h2><div class="comment"><p>I crossed it last year, a fine sight.</p></div><div class="comment"><p>Thanks for this.</p></div>
    </section><footer><p>All rights reserved.</p></footer></body>""",
    """<body><div class="cookie-notice" role="dialog"><p>We use cookies to improve this site.</p><button>Accept</button></div>
    <div id="content"><div class="post" data-content><h2>On keeping bees</h2><p>Bees need water, shade and a quiet corner of the garden.</p>
    <ul><li>Place the hive facing east.</li><li>Check it once a week.</li></ul><blockquote>A calm keeper has calm bees.</blockquote></div>
    <form class="newsletter"><label>Your address</label><input name="mail"><p>Get our letter every week.</p></form>
    <div class="advert"><p>Buy two, get one free.</p></div></div><div class="footer">Contact us by mail.</div></body>""",
    """<body><table><tr><td class="menu"><a href="/1">News</a> <a href="/2">Sport</a></td><td data-content><p>The council met on Monday and
    agreed on the plan for the harbour.</p><p>Work begins in spring.</p></td></tr></table><p class="copyright">Copyright of the paper.</p></body>""",
    """<body><nav class="breadcrumb"><a href="/">Start</a> <a href="/d">Docs</a></nav><article data-content><header><h1>Reading a tide table</h1></header>
    <section><h2>High water</h2><p>Find the day, then the port, then add the correction.</p><pre>06:12  4.1</pre></section></article>
    <div class="share"><a href="#">Share</a><a href="#">Print</a></div><div class="related"><h4>More to read</h4><p><a href="/x">Knots for beginners</a></p></div>
    <div class="banner ad"><p>Holiday cottages by the sea.</p></div><ol class="commentlist"><li><p>Very clear, thank you!</p></li></ol></body>""",
    """<body><div class="notice">This site is best seen on paper.</div><div id="page"><div class="entry-content" data-content><h1>Apples in store</h1>
    <p>Lay them on straw, apart from each other.</p><p>Look through them often.</p><div class="text"><p>Russets keep until May.</p></div></div>
    <div class="widget"><p>Popular this week</p><a href="/p">Pears</a></div></div><div id="comments"><p>We keep ours in the loft.</p><p>Same here!</p></div></body>""",
    """<body><div id="top"><a href="/">Start</a> | <a href="/c">Contact</a></div><div class="main-content" data-content><h1>Ferries</h1><p>The early boat leaves at six
    and calls at both islands.</p><p>Dogs travel free.</p></div><aside><p>Weather for sailors.</p></aside><form id="search"><p>Look for a harbour</p></form><footer>Imprint</footer></body>""",
    """<body><div class="menu"><ul><li><a href="/s">Shop</a></li></ul></div><section class="story body" data-content><h2>The lamp maker</h2><p>He works by
    the window, as his father did, and sells what he makes at the fair.</p><p>A good lamp takes him a week.</p></section><section class="promo"><p>Lamps at half
    price until Sunday.</p></section><section class="reader-comments"><article class="comment"><p>What a lovely piece.</p></article></section></body>""",
    """<body><header class="site-header"><p>Village gazette</p></header><div id="main"><div class="article-body" data-content><p>Snow closed the pass for two days.</p>
    <p>The plough came through on Thursday, and the bus is running again.</p><table><tr><td>Depth</td><td>90 cm</td></tr></table></div><div class="sidebar"><p>Offers near you
    </p></div></div><div class="subscribe"><form><p>Subscribe for news.</p></form></div><div class="site-footer"><p>Terms and privacy</p></div></body>""",
    """<body><nav><ul><li><a href="/n">Notes</a></li></ul></nav><article data-content><h1>Salt pans</h1><p>Sea water is let in at spring tide and left to the sun.</p>
    <p>The crust is raked in August.</p><aside data-other><p>Read also: the fish market</p></aside><section class="comments" data-other><h3>Comments</h3><article class="comment">
    <p>I worked there as a boy.</p></article><article class="comment"><p>Where is this?</p></article></section></article><footer>Printed weekly</footer></body>""",
    """<body><main data-content><h1>Charcoal</h1><p>The wood is stacked, covered with turf and lit from above.</p><form class="poll" data-other><p>Do you burn wood?</p></form>
    <div class="advert" data-other><p>Stoves from our maker.</p></div><p>After nine days the stack is opened.</p></main><section class="responses"><article class="response"><p>Well told.</p>
    </article><article class="response"><p>My uncle did this.</p></article></section></body>""",
]


class Node:
    __slots__ = ("tag", "names", "mark", "parent", "children", "parts")

    def __init__(self, tag: str, names: str, mark: str, parent: "Node | None"):
        self.tag, self.names, self.mark, self.parent = tag, names, mark, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []


#: One piece of a page: a comment, declaration or instruction, a tag, or text up to the next one.
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"""(?i)(?<![\w-])(class|id|role|itemprop|style|hidden|data-content|data-other)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
)
_CLOSING = {tag: re.compile(f"(?i)</{tag}(?=[\\s/>])") for tag in RAW}


def _names(rest: str) -> tuple[str, str]:
    """The naming words of a tag's attributes, and its mark on a labelled page."""
    names, mark = [], ""
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name.startswith("data-"):
            mark = name
        elif name == "hidden" or name == "style":
            if name == "hidden" or "display:none" in value.replace(" ", ""):
                names.append("hidden")
        else:
            names.append(value)
    return " ".join(names), mark


def _above(at: Node, tags: tuple[str, ...], stop: tuple[str, ...]) -> Node:
    """Where a new element belongs if it closes the nearest of ``tags``."""
    node = at
    while node.parent and node.tag not in stop:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return at


def parsed(html: str) -> Node:
    """A tolerant element tree; unclosed paragraphs, items and cells end where the next begins."""
    root = at = Node("#root", "", "", None)
    place, size = 0, len(html)
    while place < size:
        piece = _PIECE.match(html, place)
        place = piece.end()
        if piece["text"] is not None:
            at.parts.append(piece["text"])
            continue
        tag = piece["tag"] or piece["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if piece["end"] or piece["end2"]:
            node = at
            while node.parent and node.tag != tag:
                node = node.parent
            at = node.parent or at
            continue
        if tag in CLOSES_P:
            at = _above(at, ("p",), P_STOPS)
        if tag in CLOSES:
            at = _above(at, *CLOSES[tag])
        rest = piece["rest"] or piece["rest2"]
        node = Node(tag, *(_names(rest) if rest else ("", "")), at)
        at.children.append(node)
        at.parts.append(node)
        if tag in RAW:
            closing = _CLOSING[tag].search(html, place)
            place = closing.start() if closing else size
        if tag not in VOID:
            at = node
    return root


def flat(root: Node) -> tuple[list[Node], list[int]]:
    """Nodes before their children, in page order, and each one's parent, -1 for the root."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(parent)
        stack.extend((child, at) for child in reversed(node.children))
    return nodes, parents


@lru_cache(maxsize=1 << 16)
def _bucket(kind: str, value: object = "", more: object = "") -> int:
    return crc32(f"{kind} {value} {more}".encode("utf-8", "replace")) % BUCKETS


def _log_bin(n: float) -> int:
    return min(9, int(n + 1).bit_length() - 1)


def node_features(nodes: list[Node], parents: list[int]) -> list[tuple[list[int], list[int]]]:
    """Hashed features of each node: those of its names, and those of text and place."""
    n = len(nodes)
    text, linked, blocks = [0] * n, [0] * n, [0] * n
    for k, node in enumerate(nodes):
        if node.tag not in SILENT:
            text[k] = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        linked[k] = text[k] if node.tag == "a" else 0
        blocks[k] = 1 if node.tag in BLOCKS else 0
    for k in range(n - 1, 0, -1):
        if nodes[k].tag not in SILENT:
            up = parents[k]
            text[up] += text[k]
            linked[up] += text[k] if nodes[up].tag == "a" else linked[k]
            blocks[up] += blocks[k]
    whole, depth, out = max(text[0], 1), [0] * n, []
    for k, node in enumerate(nodes):
        up, tag, size = parents[k], node.tag, text[k]
        depth[k] = 0 if up < 0 else depth[up] + 1
        names = [_bucket("tag", tag), _bucket("parent", nodes[up].tag if up >= 0 else tag, tag)]
        if node.names.strip():
            found = {w.lower() for w in _NAME_WORD.findall(node.names)}
            names += [_bucket("name", w) for w in sorted(found)]
        kind = "head" if tag in HEADINGS else "block" if tag in BLOCKS else "inline"
        place = [
            _bucket("text", _log_bin(size)),
            _bucket("links", 10 * linked[k] // size if size else -1),
            _bucket("share", 10 * size // whole),
            _bucket("per block", _log_bin(size / max(blocks[k], 1))),
            _bucket("children", min(6, len(node.children))),
            _bucket("depth", min(8, depth[k])),
            _bucket(kind, _log_bin(size)),
        ]
        out.append((names, place))
    return out


class Model(NamedTuple):
    """Log odds of content by feature, and log potentials of (parent label, child label)."""

    weights: list[float]
    bias: float
    edges: list[list[float]]


def marginals(model: Model, features: list[tuple[list[int], list[int]]], parents: list[int]) -> list[float]:
    """Probability of each node to be content, by one upward and one downward pass.

    Messages are pairs of numbers scaled to add up to one, so deep trees don't underflow.
    """
    n, weights = len(features), model.weights
    (e00, e01), (e10, e11) = [[exp(x) for x in row] for row in model.edges]
    inside0, inside1, sent0, sent1 = [0.0] * n, [0.0] * n, [1.0] * n, [1.0] * n
    for k, (names, place) in enumerate(features):
        odds = model.bias + sum([weights[f] for f in names]) + sum([weights[f] for f in place])
        inside1[k] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        inside0[k] = 1 - inside1[k]
    for k in range(n - 1, 0, -1):
        a, b = e00 * inside0[k] + e01 * inside1[k], e10 * inside0[k] + e11 * inside1[k]
        sent0[k], sent1[k] = a / (a + b), b / (a + b)
        up = parents[k]
        c, d = inside0[up] * sent0[k], inside1[up] * sent1[k]
        inside0[up], inside1[up] = c / (c + d), d / (c + d)
    out = [inside1[0]] + [0.0] * (n - 1)
    for k in range(1, n):
        above = out[parents[k]]
        a, b = (1 - above) / max(sent0[k], 1e-12), above / max(sent1[k], 1e-12)
        c, d = inside0[k] * (a * e00 + b * e10), inside1[k] * (a * e01 + b * e11)
        out[k] = d / (c + d)
    return out


def seed_labels(nodes: list[Node], parents: list[int]) -> list[int] | None:
    """1 inside the marked article, 0 elsewhere; None if the page marks none, or several."""
    marked = [k for k, node in enumerate(nodes) if node.mark == "data-content"]
    if not marked:
        marked = [k for k, node in enumerate(nodes) if node.tag == "article"]
    if len(marked) != 1:
        return None
    out = [0] * len(nodes)
    out[marked[0]] = 1
    for k in range(1, len(nodes)):
        if out[parents[k]] and nodes[k].tag not in SILENT and nodes[k].mark != "data-other":
            out[k] = 1
    return out


def train(pages: list[tuple[list, list[int], list[int]]], steps: int = 120) -> Model:
    """Piecewise: logistic node potentials, and log ratios of parent and child labels.

    Nodes count twice, with and without the features of their names, so that text and
    place are learned too. Each page is (features, parents, labels).
    """
    rows, target, pairs = [], [], np.full((2, 2), 0.5)
    for features, parents, labels in pages:
        for (names, place), label in zip(features, labels):
            rows += [names + place, place]
            target += [label, label]
        for k in range(1, len(labels)):
            pairs[labels[parents[k]], labels[k]] += 1
    sizes = np.array([len(row) for row in rows], dtype=np.int64)
    index = np.fromiter((f for row in rows for f in row), np.int32, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    weights, bias, y = np.zeros(BUCKETS), 0.0, np.array(target, float)
    seen = np.full(BUCKETS, 1e-6)
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[index], begins) + bias, -30, 30)))
        error = (p - y) / len(y)
        gradient = np.bincount(index, np.repeat(error, sizes), minlength=BUCKETS) + 1e-6 * weights
        seen += gradient**2
        weights -= 0.3 * gradient / np.sqrt(seen)
        bias -= 0.3 * error.sum()
    joint = pairs / pairs.sum()
    edges = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))
    return Model(weights.tolist(), float(bias), edges.tolist())


def main_text(model: Model, html: str) -> str:
    """The content elements' text: blocks in page order, one a line."""
    root = parsed(html)
    nodes, parents = flat(root)
    if len(nodes) < 2:
        chosen = {id(root)}
    else:
        sure = marginals(model, node_features(nodes, parents), parents)
        # an element that runs inside a line goes with its line
        chosen = set()
        for k, node in enumerate(nodes):
            inline = k and node.tag not in BLOCKS
            if node.tag not in SILENT and (id(nodes[parents[k]]) in chosen if inline else sure[k] >= 0.5):
                chosen.add(id(node))
    blocks, line = [], []

    def ended() -> None:
        joined = " ".join(unescape("".join(line)).split())
        if joined:
            blocks.append(joined)
        line.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        if not k and node.tag in BLOCKS:
            ended()
        if node.tag in SILENT or k == len(node.parts):
            if node.tag in BLOCKS:
                ended()
            continue
        stack.append((node, k + 1))
        part = node.parts[k]
        if not isinstance(part, str):
            if part.tag == "br":
                line.append(" ")
            stack.append((part, 0))
        elif id(node) in chosen:
            line.append(part)
    ended()
    return "\n".join(blocks)


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nested = pa.list_(pa.list_(pa.int32()))
    for batch in batches:
        for html in batch.column(0):
            nodes, parents = flat(parsed(html.as_py() or ""))
            labels = seed_labels(nodes, parents)
            if labels is None:
                continue
            features = node_features(nodes, parents)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([[a for a, _ in features]], nested),
                    pa.array([[b for _, b in features]], nested),
                    pa.array([parents], pa.list_(pa.int32())),
                    pa.array([labels], pa.list_(pa.int32())),
                ],
                names=["names", "place", "parents", "labels"],
            )


def trained_model(pages: DataFrame, sample: int = TRAINING_PAGES) -> Model:
    """A model fitted to the ``sample`` pages of smallest id hash and the labelled pages.

    Only features of that fixed number of pages reach the driver.
    """
    ids = (
        pages.select("page_id")
        .filter(F.col("page_id").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(sample)
    )
    found = (
        pages.select("page_id", F.col("html").cast("string").alias("html"))
        .join(F.broadcast(ids), "page_id")
        .select("html")
        .mapInArrow(
            _training_batches,
            "names array<array<int>>, place array<array<int>>, parents array<int>, labels array<int>",
        )
        .collect()
    )
    known = sorted(
        ([(list(a), list(b)) for a, b in zip(r["names"], r["place"])], list(r["parents"]), list(r["labels"]))
        for r in found
    )
    made = []
    for html in LABELLED_PAGES:
        nodes, parents = flat(parsed(html))
        made.append((node_features(nodes, parents), parents, seed_labels(nodes, parents)))
    return train(known + made * max(1, len(known) // len(made)))


def _text_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                texts = [main_text(model, html or "") for html in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page row.

    Blocks are in page order, one a line, with character references decoded and white
    space inside a block as one space. Null and empty pages, and pages without content,
    give an empty text; a page without any element is its own text. Null and repeated ids
    pass through; other columns play no part; an empty table gives no rows.
    """
    model = model or trained_model(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return own.mapInArrow(_text_batches(shared), PAGE_SCHEMA)
