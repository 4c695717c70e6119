"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are elements and their text blocks, each content or not. A node's potential is
log-linear in structural features; parent-child potentials tie a node to its parent,
with tables of their own for text blocks and for elements. Sum-product messages go
from the leaves to the root and back; a block belongs to the article if its marginal
is at least one half. Weights are trained on labelled pages by gradient ascent on the
exact likelihood, whose expectations are the same marginals.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .labelled_pages import MARK, pages

STEPS, RATE, DECAY = 250, 0.05, 2e-4
#: Depth from which elements hang side by side.
MOST_DEPTH = 512

# Fixed values of HTML: element groups.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe head title textarea select option optgroup button object canvas math datalist".split())
RAW = frozenset("script style iframe title textarea".split())
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
PAIRED = frozenset("noscript template svg select button object canvas math datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "thead": ["tbody", "thead"], "tbody": ["tbody", "thead"], "option": ["option"]}
SCOPE = frozenset("ul ol dl table div article section main body".split())
GROUPS = ["body html", "nav menu", "header", "footer address", "aside", "form fieldset", "article", "main", "section", "div", "p blockquote pre", "ul ol dl", "li dt dd", "h1", "h2 h3 h4 h5 h6", "table tr td th tbody thead", "a", "figure figcaption"]
GOOD = re.compile(r"content|article|post|entry|main|story|text|body", re.I)
BAD = re.compile(
    r"(?:^|[^a-z])(?:ads?|nav|menu|tags?)(?:$|[^a-z])|advert|sponsor|promo|banner|navbar|breadcrumb|header|masthead|foot|copyright|side|cookie|notice|consent|alert|popup|modal|comment|respond|discuss|reply|disqus|share|social|related|recommend|newsletter|subscri|signup|login|form|search|widget|toolbar|pager|paginat", re.I
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_PAIR = {t: re.compile(rf"<(/?){t}\b", re.I) for t in PAIRED}
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
WIDTH = len(GROUPS) + 12


@dataclass
class Tree:
    """Nodes in page order: parent (-1: root), whether it is a text block, features; texts of the blocks."""

    parent: list[int]
    leaf: list[bool]
    depth: list[int]
    rows: list[tuple]
    texts: list[str]


def _next(page: str, at: int, last: int) -> re.Match | None:
    """The next markup; a tag whose quotes don't close ends at its first >. last: place of the page's last >."""
    while (at := page.find("<", at)) >= 0:
        if at < last or page.startswith("<!--", at):
            if m := TOKEN.match(page, at) or LOOSE.match(page, at):
                return m
        at += 1
    return None


class _Open:
    """The open elements: tag, node (inline elements: -1) and whether text below is hidden; places by tag, so that no search walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]
        self.blocks, self.scopes = [0], [0]  # places of elements that are not inline, and of those that end a search
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, node, self.stack[-1][2] or tag in HIDDEN))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Tree:
    """A tolerant reading, in time linear in the page.

    What is left open is closed by its parent's end tag. Hidden elements are elements like others,
    whose text is left out; head ends where the body's content begins, an option where a block begins.
    A script or style without an end hides the rest of the page, as in browsers; other hidden elements
    that are not closed before the next of their kind hide nothing. Elements below MOST_DEPTH hang at that depth, as in browsers.
    """
    parent, leaf, depth, tags, marks, own, links_in, stops, texts = [-1], [False], [0], ["html"], [(False, False)], [0], [0], [0], [""]
    open_ = _Open()
    buffer: list[str] = []
    links = 0  # letters of the buffer that stand in a link
    endless: set[str] = set()  # raw elements that don't end any more

    def node(up: int, tag: str, mark: tuple[bool, bool], text: str = "", linked: int = 0) -> int:
        if depth[up] >= MOST_DEPTH:
            up = parent[up]
        parent.append(up)
        leaf.append(not tag)
        depth.append(depth[up] + 1)
        tags.append(tag)
        marks.append(mark)
        own.append(len(text))
        links_in.append(min(linked, len(text)))
        stops.append(text.count(".") + text.count("!") + text.count("?"))
        texts.append(text)
        return len(parent) - 1

    def flush() -> None:
        nonlocal links
        said = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if said:
            node(open_.stack[open_.blocks[-1]][1], "", (False, False), said, links)
        links = 0

    def text(part: str) -> None:
        nonlocal links
        if part and not open_.stack[-1][2]:
            buffer.append(part)
            if any(t == "a" for t, _, _ in open_.stack[-3:]):
                links += len(part)

    at, last = 0, page.rfind(">")
    while m := _next(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if m[1]:
            if not inline:
                flush()
            found = open_.last(tag)
            if found and (not inline or found > open_.blocks[-1]):
                open_.pop(found)
            continue
        if tag == "br" or tag == "hr":
            flush()
        if tag in VOID:
            continue
        if not inline:
            flush()
        if tag in RAW:
            if tag in endless:
                continue
            end = _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                endless.add(tag)
            continue
        if tag in PAIRED:
            pair = None if tag in endless else _PAIR[tag].search(page, at)
            if not pair:
                endless.add(tag)
            if not pair or not pair[1]:
                continue  # left open: it hides nothing
        if open_.places.get("head") and tag not in IN_HEAD:
            open_.pop(open_.places["head"][-1])
        if tag in CLOSES_P:
            if open_.stack[open_.blocks[-1]][0] in ("option", "optgroup"):
                open_.pop(open_.blocks[-1])
            block = open_.blocks[-1]
            if open_.stack[block][0] == "p":
                open_.pop(block)
        if tag in SAME:
            found = open_.last(*SAME[tag])
            if found > open_.scopes[-1]:
                open_.pop(found)
        if (tag == "html" and len(parent) == 1) or (m[0].endswith("/>") and not inline):
            continue
        if inline:
            open_.push(tag, -1)  # no node of the model; it stays open for its text
        else:
            rest = m[3]
            said = " ".join(x for y in ATTRIBUTE.findall(rest) for x in y if x) if rest else ""
            open_.push(tag, node(open_.stack[open_.blocks[-1]][1], tag, (bool(said and GOOD.search(said)), bool(said and BAD.search(said)))))
    text(page[at:])
    flush()
    size, linked, ends = own, links_in, stops
    for k in range(len(parent) - 1, 0, -1):  # children stand behind their parents
        up = parent[k]
        size[up] += size[k]
        linked[up] += linked[k]
        ends[up] += ends[k]
    live = [k for k in range(len(parent)) if size[k] or k == 0]
    new = {k: i for i, k in enumerate(live)}
    real = [new[parent[k]] if k else -1 for k in live]
    total = max(size[0], 1)
    rows = [(_GROUP.get(tags[k], -1), *marks[k], size[k], linked[k], ends[k], size[k] / total) for k in live]
    return Tree(real, [leaf[k] for k in live], [depth[k] for k in live], rows, [texts[k] for k in live])


@dataclass
class Batch:
    """Trees side by side; features of all nodes, and nodes by depth."""

    parent: np.ndarray
    leaf: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]

    @property
    def kind(self) -> np.ndarray:
        """Which table ties a node to its parent."""
        named = self.x[:, [_GROUP["article"], _GROUP["main"]]].any(axis=1)
        return self.leaf.astype(np.int64) + 2 * named[np.maximum(self.parent, 0)]


def assemble(trees: list[Tree]) -> Batch:
    sizes = [len(t.parent) for t in trees]
    shift = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    parent = np.concatenate([np.array(t.parent) for t in trees])
    parent = np.where(parent < 0, -1, parent + shift)
    leaf = np.concatenate([np.array(t.leaf) for t in trees])
    depth = np.concatenate([np.array(t.depth) for t in trees])
    raw = np.array([r for t in trees for r in t.rows], np.float64)
    n = len(raw)
    x = np.zeros((n, WIDTH))
    group = raw[:, 0].astype(np.int64)
    on = np.flatnonzero((group >= 0) & ~leaf)
    x[on, group[on]] = 1
    g = len(GROUPS)
    size, links, stops = np.maximum(raw[:, 3], 1), raw[:, 4], raw[:, 5]
    own = leaf.astype(float)
    x[:, g] = raw[:, 1]
    x[:, g + 1] = raw[:, 2]
    x[:, g + 2] = own
    x[:, g + 3] = own * np.log1p(np.minimum(size, 400)) / 5
    x[:, g + 4] = own * (links / size)
    x[:, g + 5] = own * (stops > 0)
    x[:, g + 6] = (1 - own) * np.log1p(np.minimum(size, 400)) / 5
    x[:, g + 7] = (1 - own) * (links / size)
    x[:, g + 8] = (1 - own) * (stops > 1)
    x[:, g + 9] = (1 - own) * raw[:, 6]
    x[:, g + 10] = (1 - own) * (raw[:, 6] > 0.99)
    x[:, g + 11] = 1
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    return Batch(parent, leaf, x, [order[a:b] for a, b in zip(cut, cut[1:], strict=False)])


@dataclass
class Model:
    weight: np.ndarray
    tie: np.ndarray  # by kind (text block or not, parent an article or not), state of the parent, state of the child


def _soft(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(b: Batch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each node (two states), and joint ones of each node with its parent."""
    n = len(b.parent)
    local = np.zeros((n, 2))
    local[:, 1] = b.x @ model.weight
    tie = model.tie[b.kind]
    up = np.zeros((n, 2))
    for nodes in reversed(b.levels[1:]):
        up[nodes] = _soft(local[nodes][:, None, :] + tie[nodes], 2)
        np.add.at(local, b.parent[nodes], up[nodes])
    belief = local
    pair = np.zeros((n, 2, 2))
    for nodes in b.levels[1:]:
        above = belief[b.parent[nodes]] - up[nodes]
        joint = above[:, :, None] + tie[nodes] + belief[nodes][:, None, :]
        down = _soft(above[:, :, None] + tie[nodes], 1)
        pair[nodes] = np.exp(joint - _soft(joint.reshape(len(nodes), 4), 1)[:, None, None])
        belief[nodes] += down
    return np.exp(belief - _soft(belief, 1)[:, None]), pair


@lru_cache(1)
def train() -> Model:
    """The model of the labelled pages; an element is content if over half of its text is."""
    trees = [parse(p) for p in pages()]
    b = assemble(trees)
    texts = [t for tree in trees for t in tree.texts]
    size = np.array([r[3] if k else 0 for tree in trees for r, k in zip(tree.rows, tree.leaf, strict=True)], float)
    good = size * np.array([MARK in t for t in texts])
    for nodes in reversed(b.levels[1:]):
        np.add.at(size, b.parent[nodes], size[nodes])
        np.add.at(good, b.parent[nodes], good[nodes])
    y = good > 0.5 * size
    y = y.astype(np.int64)
    child = np.flatnonzero(b.parent >= 0)
    kind = b.kind[child]
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (kind, y[b.parent[child]], y[child]), 1)
    theta = np.zeros(WIDTH + 16)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        model = Model(theta[:WIDTH], theta[WIDTH:].reshape(4, 2, 2))
        one, two = marginals(b, model)
        hope = np.zeros((4, 2, 2))
        np.add.at(hope, kind, two[child])
        g = np.concatenate([b.x.T @ (y - one[:, 1]), (seen - hope).ravel()]) / len(trees) - DECAY * len(y) / len(trees) * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(4, 2, 2))


def extract(found: list[str], model: Model) -> list[str]:
    if not found:
        return []
    trees = [parse(p) for p in found]
    b = assemble(trees)
    keep = (marginals(b, model)[0][:, 1] >= 0.5) & b.leaf
    out, at = [], 0
    for t in trees:
        out.append(" ".join(x for x, k in zip(t.texts, keep[at : at + len(t.texts)], strict=True) if k))
        at += len(t.texts)
    return out


def main_text(source: DataFrame, model: Model | None = None, column: str = "html") -> DataFrame:
    """All columns of source but the markup, with text and n_chars behind them (columns so named are replaced).

    A null or empty page, and one without an article, has an empty text. Each row is
    worked on alone, so repeated rows give equal texts.
    """
    model = model or train()
    source = source.drop("text", "n_chars")
    kept = [c for c in source.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                text = extract([x or "" for x in part[column].to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], [*kept, "text", "n_chars"])

    return source.mapInArrow(run, tables.with_columns(source.select(kept).schema, [("text", "string"), ("n_chars", "long")]))


def op4_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(tables.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
