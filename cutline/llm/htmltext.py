"""Main text of HTML pages: boosted trees over DOM nodes, hierarchical decoding.

Each element is a node with features: its tag group, tokens of its class, id and role, those of
its ancestors, depth, place among its siblings, and densities of its subtree (text, links, marks,
words per block). Boosted trees (Spark ML) give the probability that a node holds main text.
They learn from a bounded sample of pages: the nodes of the pages themselves, labelled by the
plain cases (article and main elements, navigation, footers, marked adverts), and the same texts
laid out again with every kind of surroundings, whose labels are known.

Decoding picks the most likely labels under one rule: a node can only be main text if its parent
is. The best choice of a subtree is either to drop all of it or to keep its root and the best of
its children, so one pass from the leaves up finds the optimum and no ancestor contradicts a
descendant.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import without

SAMPLE_PAGES = 120
TREES = 25
DEPTH = 4
LAYOUTS = 2
SEED = 11

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg iframe object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
GROUPS = (
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "select", "textarea", "label", "input"),
    ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "li", "dl", "dt", "dd"), ("a",), ("div", "section", "center"),
    ("table", "tbody", "tr", "td", "th"), ("dialog", "details"), ("body", "html"),
)
TOKENS = (
    ("article", "content", "post", "entry", "main", "story", "body", "text", "copy"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager"),
    ("header", "masthead", "topbar", "banner", "branding", "logo"),
    ("footer", "foot", "bottom", "copyright", "colophon"),
    ("sidebar", "aside", "side", "widget", "related", "recommended", "trending", "complementary", "more"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "contentinfo"),
    ("comment", "comments", "reply", "replies", "disqus", "respond", "discussion", "reactions"),
    ("form", "login", "search", "contact", "share", "sharing", "social", "tags", "meta", "author", "byline"),
)
CONTROLS = frozenset("button label input textarea".split())
_MARKS = re.compile("[.,;:!?]")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_WORD = re.compile(r"[a-z]+")
_BOILER = range(1, 9)
_NO_TOKENS: frozenset = frozenset()
_BOILER_TOKENS = frozenset(t for k in _BOILER for t in TOKENS[k])


@dataclass
class Node:
    tag: str
    tokens: frozenset
    parent: int
    depth: int
    children: list[int] = field(default_factory=list)
    main: bool | None = None


class _Tree(HTMLParser):
    """Nodes in page order and (node, text, in a link) pieces; unclosed and misnested tags end with their parent.

    Nodes are blocks, silent elements, form controls and inline elements that bear a token of a
    boilerplate group; the text of other inline elements belongs to the node around them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", frozenset(), -1, 0)]
        self.pieces: list[tuple[int, str, bool]] = []
        self.open = [("", 0)]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag, {"p"} if tag in BLOCK and tag not in VOID else ())
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in closes:
                del self.open[at:]
                break
            if name in BLOCK and name != "p":
                break
        values = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "data-main")) if attrs else ""
        tokens = frozenset(_WORD.findall(_CAMEL.sub(r"\1 \2", values).lower())) if values else _NO_TOKENS
        node = parent = self.open[-1][1]
        if tag in BLOCK or tag in SILENT or tag in CONTROLS or not tokens.isdisjoint(_BOILER_TOKENS):
            node = len(self.nodes)
            self.nodes.append(Node(tag, tokens, parent, self.nodes[parent].depth + 1))
            self.nodes[parent].children.append(node)
        if tag in BLOCK:
            self.pieces.append((node, " ", False))
        if tag not in VOID:
            self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                if tag in BLOCK:
                    self.pieces.append((self.open[at][1], " ", False))
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1][1], data, any(name == "a" for name, _ in self.open)))


def parse(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree


FEATURES = (
    [f"tag_{g[0]}" for g in GROUPS] + [f"own_{t[0]}" for t in TOKENS] + [f"above_{t[0]}" for t in TOKENS] + [f"above_tag_{g[0]}" for g in GROUPS[:6]]
    + ["depth", "sibling", "siblings", "share", "length", "links", "marks", "blocks", "words_per_block", "head_share"]
)


@lru_cache(maxsize=20_000)
def _own(tag: str, tokens: frozenset) -> np.ndarray:
    """The features that follow from a node's tag and tokens; pages repeat them often."""
    return np.array([tag in group for group in GROUPS] + [not tokens.isdisjoint(group) for group in TOKENS], float)


def features(tree: _Tree) -> np.ndarray:
    """One row of ``FEATURES`` per node; subtree sums run from the last node up, as children follow parents."""
    n = len(tree.nodes)
    chars, linked, marks, blocks, words = np.zeros((5, n))
    silent = np.zeros(n, dtype=bool)
    for i, node in enumerate(tree.nodes):
        silent[i] = node.tag in SILENT or (node.parent >= 0 and silent[node.parent])
        blocks[i] = node.tag in BLOCK
    for i, text, in_link in tree.pieces:
        if not silent[i]:
            size = len(text.strip())
            chars[i] += size
            linked[i] += size * in_link
            marks[i] += len(_MARKS.findall(text))
            words[i] += len(text.split())
    for i in range(n - 1, 0, -1):
        parent = tree.nodes[i].parent
        for sums in (chars, linked, marks, blocks, words):
            sums[parent] += sums[i]
    ahead = np.cumsum(chars) - chars
    out = np.zeros((n, len(FEATURES)))
    g, t = len(GROUPS), len(TOKENS)
    for i, node in enumerate(tree.nodes):
        row = out[i]
        row[: g + t] = _own(node.tag, node.tokens)
        if node.parent >= 0:
            above = out[node.parent]
            row[g + t : g + 2 * t] = np.maximum(above[g + t : g + 2 * t], above[g : g + t])
            row[g + 2 * t : g + 2 * t + 6] = np.maximum(above[g + 2 * t : g + 2 * t + 6], above[:6])
            order = tree.nodes[node.parent].children
            first = order[0]
            row[-9], row[-8] = (i - first) / max(1, order[-1] - first), np.log1p(len(order))
        total = max(1.0, chars[0])
        row[-10] = node.depth
        row[-7], row[-6] = chars[i] / total, np.log1p(chars[i])
        row[-5], row[-4] = linked[i] / max(1.0, chars[i]), marks[i] / max(1.0, words[i])
        row[-3], row[-2] = np.log1p(blocks[i]), words[i] / max(1.0, blocks[i])
    out[:, -1] = ahead / max(1.0, chars.sum())
    return out


def labels(tree: _Tree) -> np.ndarray:
    """Plain cases: 1 holds main text, 0 does not, -1 not known."""
    n = len(tree.nodes)
    out = np.full(n, -1)
    holds = np.zeros(n, dtype=bool)
    for i, node in enumerate(tree.nodes):
        above = out[node.parent] if node.parent >= 0 else -1
        boiler = node.tag in {"nav", "footer", "aside", "form", "menu", "dialog", "button"} | SILENT or (node.tag == "header" and above != 1)
        boiler = boiler or any(not node.tokens.isdisjoint(TOKENS[k]) for k in _BOILER)
        if "keptmain" in node.tokens:
            out[i] = 1
        elif "keptout" in node.tokens or above == 0:
            out[i] = 0
        elif boiler:
            out[i] = 0
        elif node.tag in ("article", "main") or above == 1:
            out[i] = 1
    for i in range(n - 1, 0, -1):
        holds[i] |= out[i] == 1
        holds[tree.nodes[i].parent] |= holds[i]
    out[holds] = 1
    return out


def _laid_out(texts: list[str], links: list[str], rng: random.Random) -> str:
    """A page with known labels: the texts as its article among surroundings of every kind."""

    def some(words: int) -> str:
        pool = " ".join(links + [t for t in texts if t]).split() or ["word"]
        return " ".join(rng.choice(pool) for _ in range(words))

    def name(group: int) -> str:
        token = rng.choice(TOKENS[group])
        return rng.choice([f'class="{token}"', f'id="{token}"', f'class="{token}-box x{rng.randrange(9)}"', f'class="site_{token}"'])

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{some(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"

    def out(tag: str, inner: str, group: int | None) -> str:
        own = name(group) if group is not None and (tag == "div" or rng.random() < 0.5) else ""
        return f'<{tag} {own} data-main="keptout">{inner}</{tag}>'

    def paragraphs(k: int) -> str:
        return "".join(f"<p>{some(rng.randint(5, 40))}</p>" for _ in range(k))

    before = [
        out(rng.choice(["nav", "div"]), menu(), 1), out(rng.choice(["header", "div"]), f"<h1>{some(3)}</h1>" * rng.randint(0, 1) + some(4), 2),
        out("div", some(rng.randint(4, 25)), 5), out(rng.choice(["div", "dialog"]), f"<p>{some(15)}</p><button>{some(1)}</button>", 6),
        out("form", f"<label>{some(2)}</label><input name=q><button>{some(1)}</button>", 8),
    ]
    after = [
        out(rng.choice(["aside", "div"]), f"<h3>{some(2)}</h3>" + (menu() if rng.random() < 0.5 else paragraphs(2)), 4),
        out(rng.choice(["section", "div"]), "".join(f'<div class="comment"><b>{some(2)}</b><p>{some(rng.randint(5, 60))}</p></div>' for _ in range(rng.randint(1, 6))), 7),
        out(rng.choice(["footer", "div"]), f"&copy; {some(8)}" + (menu() if rng.random() < 0.5 else f"<p>{some(20)}</p>"), 3),
        out("form", f"<p>{some(6)}</p><textarea></textarea>", 8), out("div", menu(), 8),
    ]
    inner = [f"<p>{t}</p>" if rng.random() < 0.9 else f"<div>{t}</div>" for t in texts]
    for _ in range(rng.choice([0, 0, 1, 1, 2])):  # surroundings stand inside the article as often as beside it
        kind = rng.choice([5, 5, 4, 8, 6])
        inside = {4: lambda: menu() if rng.random() < 0.5 else paragraphs(2), 6: lambda: f"<p>{some(15)}</p>", 8: lambda: f"<p>{some(6)}</p>"}
        inner.insert(rng.randint(0, len(inner)), out("div", inside.get(kind, lambda: some(rng.randint(2, 20)))(), kind))
    if rng.random() < 0.3:
        inner.insert(rng.randint(0, len(inner)), f"<ul><li>{some(9)}</li><li>{some(12)}</li></ul>")
    if rng.random() < 0.3:
        inner.append(after.pop(1))
    body = f"<h1>{some(rng.randint(1, 9))}</h1>" + "".join(inner)
    tag = rng.choice(["article", "main", "div", "div", "section"])
    kept = f'<{tag} {name(0) if rng.random() < 0.7 else ""} data-main="keptmain">{body}</{tag}>'
    picked = [x for x in before if rng.random() < 0.6], [x for x in after if rng.random() < 0.6]
    page = "".join([*rng.sample(picked[0], len(picked[0])), kept, *rng.sample(picked[1], len(picked[1]))])
    return f"<html><head><title>{some(4)}</title></head><body>{f'<div id=page>{page}</div>' if rng.random() < 0.5 else page}</body></html>"


def training_rows(pages: list[str], seed: int = SEED) -> list[tuple[list[float], float]]:
    """(features, label) of the nodes of the sample pages and of their texts laid out again."""
    rng = random.Random(seed)
    rows = []
    for html in pages:
        tree = parse(html)
        marked = labels(tree)
        texts: dict[int, str] = {}
        for i, text, _ in tree.pieces:
            if marked[i] == 1:
                texts[i] = texts.get(i, "") + text
        links = [t for _, t, in_link in tree.pieces if in_link][:20]
        kept = [t.strip().replace("<", "&lt;") for t in texts.values() if t.strip()][:15]
        for layout in [tree, *([parse(_laid_out(kept or ["text"], links, rng)) for _ in range(LAYOUTS)])]:
            x, y = features(layout), labels(layout)
            rows += [(x[i].tolist(), float(y[i])) for i in range(1, len(y)) if y[i] >= 0]
    return rows


@dataclass
class Forest:
    """Boosted trees as arrays: feature, threshold, children and value of every node; roots; weights."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    weights: list[float]

    def __post_init__(self) -> None:
        """A leaf is its own child, so that all trees can go down together, however deep each is."""
        leaf = self.feature < 0
        self.asked = np.where(leaf, 0, self.feature)
        own = np.arange(len(leaf))
        self.children = np.stack([np.where(leaf, own, self.right), np.where(leaf, own, self.left)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(np.array(self.roots), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            below = self.children[at, (x[rows, self.asked[at]] <= self.threshold[at]).astype(np.int64)]
            if np.array_equal(below, at):
                return 1 / (1 + np.exp(-2 * (self.value[at] * np.array(self.weights)).sum(1)))
            at = below


def _arrays(model) -> Forest:
    columns: list[list] = [[], [], [], [], []]

    def add(node) -> int:
        at = len(columns[0])
        for c in columns:
            c.append(-1)
        columns[1][at], columns[4][at] = 0.0, node.prediction()
        if node.subtreeDepth() > 0:
            columns[0][at], columns[1][at] = node.split().featureIndex(), node.split().threshold()
            columns[2][at] = add(node.leftChild())
            columns[3][at] = add(node.rightChild())
        return at

    roots = [add(tree._java_obj.rootNode()) for tree in model.trees]
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(*(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), roots, list(model.treeWeights))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Forest:
    """Train on the ``sample_pages`` pages with the smallest hash of their id; only those reach the driver."""
    html = F.col(f"`{html_col}`")
    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`")).alias("h")).filter("id is not null").distinct().orderBy("h", "id").limit(sample_pages)
    sample = pages.select(F.col(f"`{id_col}`").alias("id"), html.alias("html")).join(F.broadcast(picked), "id").filter("html is not null")
    chosen = sorted({r["html"] for r in sample.select("html").collect()}) or ["<article><p>text</p></article>"]
    rows = training_rows(chosen)
    # Partitions and their order follow from the rows alone, so the trees are the same on every cluster.
    numbered = [(i, i % 4, x, y) for i, (x, y) in enumerate(rows)]
    frame = pages.sparkSession.createDataFrame(numbered, "i long, part long, x array<double>, y double").repartition(4, "part").sortWithinPartitions("i")
    frame = frame.select(array_to_vector("x").alias("x"), "y").persist()
    try:
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(frame)
    finally:
        frame.unpersist()
    return _arrays(model)


def decode(tree: _Tree, probability: np.ndarray) -> np.ndarray:
    """The most likely labels in which a node is kept only if its parent is; the root always is."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    drop, keep = np.log(1 - p), np.log(p)
    best = np.zeros(len(p))
    for i in range(len(p) - 1, 0, -1):
        if tree.nodes[i].tag in SILENT:
            keep[i] = -np.inf
        best[i] = max(drop[i], keep[i])
        parent = tree.nodes[i].parent
        drop[parent] += drop[i]
        keep[parent] += best[i]
    kept = np.zeros(len(p), dtype=bool)
    kept[0] = True
    for i in range(1, len(p)):
        kept[i] = kept[tree.nodes[i].parent] and keep[i] > drop[i]
    return kept


def main_text(html: str | None, forest: Forest) -> str:
    tree = parse(html)
    kept = decode(tree, forest.probability(features(tree)))
    return " ".join("".join(text if kept[i] else " " for i, text, _ in tree.pieces).split())


def extract(pages: DataFrame, forest: Forest, html_col: str = "html", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Add the main text of each page and its length in code points; null and empty pages have none.

    Columns that bear the new names are replaced.
    """
    base = without(pages, [text_col, size_col])
    schema = T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType()), T.StructField(size_col, T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch[html_col]]
            yield batch.assign(**{text_col: texts, size_col: [len(t) for t in texts]})

    return base.mapInPandas(read, schema)
