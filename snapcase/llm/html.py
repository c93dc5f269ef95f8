"""Main text of web pages: boosted trees over DOM nodes, decoded down the hierarchy.

A page becomes a tree of block nodes.  Each node has features: its own and its parent's
tag group, attribute tokens that speak for or against main text, depth, place among its
siblings, and the text, link, word and tag density of its subtree.  Boosted trees give
each node the log odds of being main text rather than boilerplate.

Decoding walks from the root and makes ancestors and descendants agree: a block of text
takes the best-supported labelling of the path above it, in which a boundary costs
``SWITCH``; below a node decided as boilerplate with confidence nothing is taken back.
Concretely each node chooses main or boilerplate for its whole subtree, or leaves the
choice to its children, whichever has the largest total (a dynamic programme from the
leaves up).  A main subtree holds no boilerplate node and the other way round, so no
contradiction is possible.

The trees are trained here, on a bounded sample of the pages.  Their elements that HTML
itself defines as main text or not (article, main; nav, header, footer, aside, form) are
the labels.  Each sampled page is also taken apart and rebuilt with other markup: plain
div elements named by class or id, sidebars, notices, adverts, forms and reader comments
made from the sample's own sentences, so the trees learn from attribute tokens, density
and position and not from one tag.  Every node passes through the model; scripts, styles
and other elements without visible text are left out by the parser.

Rows: null and empty pages give empty text; markup cut off anywhere, unclosed or
misnested, is read as browsers do (p, li and table parts close implicitly, stray end tags
are ignored); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees

# Pages that the model is trained on at most (those with the smallest hashes), and the
# longest of them in characters; every page is extracted whole.
SAMPLE_PAGES = 160
SAMPLE_CHARS = 60_000
# Pages that the model scores at once.
CHUNK = 64
# Cost, in log odds per node, of a boundary between main text and boilerplate.
SWITCH = 0.5

# Element groups of HTML, and words that class and id attributes use.
HIDDEN = frozenset("script style noscript template iframe object svg math head title select "
                   "option textarea button canvas audio video map datalist".split())
# Read to their end tag, or to the end of the page, whatever they hold.
RAW_TEXT = frozenset("script style title textarea".split())
# Skipped with all they hold; without an end tag they hold nothing.
SKIPPED = frozenset("noscript template iframe svg math select object canvas audio video datalist "
                    "button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
GROUPS = {name: i for i, group in enumerate((
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "dialog"), ("p", "blockquote", "pre", "figcaption"),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
    ("table", "tbody", "thead", "tr", "td", "th"), ("body", "html"), ("div", "section")))
    for name in group}
N_GROUPS = 14
GOOD = frozenset("article articlebody body content entry main post story text prose hentry page "
                 "blogpost".split())
BAD = {word: i for i, words in enumerate((
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "header masthead banner topbar branding logo",
    "footer foot copyright colophon legal",
    "sidebar aside side rail widget related recommended recirculation more",
    "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion dfp",
    "cookie cookies consent notice notices alert gdpr popup modal overlay disclaimer warning",
    "comment comments reply replies discussion disqus respondent feedback reviews",
    "form search login signup subscribe newsletter register share social sharing")) for word in words.split()}
N_BAD = 8
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"),
}
# Where the search for an element to close stops.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
         "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",)}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table "
                     "ul dialog".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|"
    r"'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """A block element, or a run of text directly inside one."""
    tag: str
    tokens: tuple[str, ...] = ()
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)     # of a text run
    links: int = 0                                     # characters inside links, of a text run
    label: int | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        found += _TOKEN.findall(_CAMEL.sub(" ", value).lower())
    return tuple(found)


def element_ends(page: str, name: str) -> dict[int, int]:
    """Where each element of that name ends, by where it starts; those without an end tag are left out."""
    started, ends = [], {}
    for m in re.finditer(rf"<(/?){re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)", page, re.I):
        if not m[1]:
            started.append(m.start())
        elif started:
            ends[started.pop()] = m.end()
    return ends


def parse(page: str | None) -> Node:
    """The tree of block elements and text runs of a page."""
    page = page or ""
    root = Node("root")
    ends: dict[str, dict[int, int]] = {}
    here, in_link, at = root, 0, 0
    stack = [root]

    def text(data: str) -> None:
        if not data:
            return
        if "&" in data:
            data = entities.unescape(data)
        if here.children and here.children[-1].tag == "#text":
            run = here.children[-1]
        elif data.strip():
            run = here.add(Node("#text"))
        else:
            return
        run.parts.append(data)
        if in_link:
            run.links += len(data.strip())

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        nonlocal here
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                here = stack[-1]
                return
            if stack[i].tag in scope:
                return

    while m := _MARKUP.search(page, at):
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in ("br", "p") and not any(n.tag == name for n in stack):
                text("\n")
            elif name not in INLINE:
                if name in ("body", "html"):
                    continue
                close((name,), ("td", "th", "table") if name == "p" else ())
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in SKIPPED:
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                if name not in ends:
                    ends[name] = element_ends(page, name)
                at = max(at, ends[name].get(m.start(), at))
            continue
        if name == "a":
            in_link += 1
        elif name == "br" or name == "hr":
            if name == "hr":
                close(("p",), ("table", "td", "th"))
            text("\n") if here.children else None
        elif name in VOID or name in INLINE or name in ("head",):
            continue
        else:
            if name in CLOSES_P:
                close(("p",), ("table", "td", "th", "li", "article", "section", "div", "aside",
                               "nav", "footer", "header", "main", "form", "blockquote"))
            if name in IMPLIED_END:
                close(IMPLIED_END[name], SCOPE.get(name, ()))
            in_link = 0
            here = here.add(Node(name, attribute_tokens(m[3])))
            stack.append(here)
    text(page[at:])
    return root


def block_text(run: Node) -> str:
    """Text of a run, white space turned into single spaces and trimmed."""
    return " ".join("".join(run.parts).split())


def _bits(masks: list[int], width: int) -> np.ndarray:
    return (np.array(masks, dtype=np.int64)[:, None] >> np.arange(width)) & 1


@dataclass
class Table:
    """The nodes of a tree in page order, the place of each one's parent, and features."""
    nodes: list[Node]
    parent: np.ndarray
    x: np.ndarray


def node_table(root: Node) -> Table:
    nodes: list[Node] = []
    parent, depth, position, siblings = [], [], [], []
    hints, above, groups, above_groups = [], [], [], []
    sums = []                                     # chars, link chars, words, stops, tags, runs
    stack = [(root, -1, 0, 1)]
    while stack:
        node, up, place, among = stack.pop()
        at = len(nodes)
        nodes.append(node)
        parent.append(up)
        depth.append(depth[up] + 1 if at else 0)
        position.append(place)
        siblings.append(among)
        hint = 0
        for token in node.tokens:
            if token in BAD:
                hint |= 1 << BAD[token]
            elif token in GOOD:
                hint |= 1 << N_BAD
        hints.append(hint)
        above.append(above[up] | hints[up] if at else 0)
        above_groups.append(above_groups[up] | groups[up] if at else 0)
        if node.tag == "#text":
            data = block_text(node)
            groups.append(0)
            sums.append((len(data), min(node.links, len(data)), data.count(" ") + 1,
                         data.count(".") + data.count("!") + data.count("?") + data.count(","),
                         0, 1))
        else:
            groups.append(1 << GROUPS.get(node.tag, N_GROUPS - 1))
            sums.append((0, 0, 0, 0, 1, 0))
            n = len(node.children)
            for j in range(n - 1, -1, -1):
                stack.append((node.children[j], at, j, n))
    total = [list(x) for x in sums]
    for i in range(len(nodes) - 1, 0, -1):
        to = total[parent[i]]
        for j, v in enumerate(total[i]):
            to[j] += v
    sums = np.array(total, dtype=float)
    parents = np.array(parent)
    up = np.maximum(parents, 0)
    chars = sums[:, 0]
    runs = np.array([n.tag == "#text" for n in nodes])
    dense = np.column_stack((
        depth, np.array(position) / siblings, np.log1p(siblings), np.log1p(chars),
        chars / max(1.0, chars[0]), sums[:, 1] / (chars + 1), sums[:, 3] / (sums[:, 2] + 1),
        chars / (sums[:, 4] + 1), sums[:, 2] / (sums[:, 5] + 1),
        sums[up, 1] / (sums[up, 0] + 1), chars / (sums[up, 0] + 1), runs))
    x = np.hstack((_bits(groups, N_GROUPS), _bits(above_groups, N_GROUPS),
                   _bits(hints, N_BAD + 1), _bits(above, N_BAD + 1), dense))
    return Table(nodes, parents, x)


def decode(table: Table, margin: np.ndarray) -> list[Node]:
    """Text runs of main text: the best consistent labelling of the tree.

    For every node the best total of its subtree is that of all main, all boilerplate, or
    of each child on its own less ``SWITCH``; totals are log odds of main text, summed.
    """
    n, parent = len(table.nodes), table.parent.tolist()
    # Boilerplate counts 0, main text the sum of log odds below and at a node.
    main, below = margin.tolist(), [0.0] * n
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        split = below[i] - SWITCH if table.nodes[i].children else float("-inf")
        best[i] = max(main[i], split, 0.0)
        if i:
            main[parent[i]] += main[i]
            below[parent[i]] += best[i]
    inside = [False] * n
    open_ = [False] * n
    out = []
    for i, node in enumerate(table.nodes):
        if i and inside[parent[i]]:
            inside[i] = True
        elif i == 0 or open_[parent[i]]:
            inside[i] = best[i] > 0.0 and best[i] == main[i]
            open_[i] = best[i] > 0.0 and not inside[i]
        if inside[i] and node.tag == "#text":
            out.append(node)
    return out


def extract(model: trees.Trees, pages: list[str | None]) -> list[str]:
    """Main texts of pages."""
    tables = [node_table(parse(p)) for p in pages]
    margins = model.margin(np.vstack([t.x for t in tables])) if tables else np.empty(0)
    out, at = [], 0
    for t in tables:
        runs = decode(t, margins[at:at + len(t.nodes)])
        at += len(t.nodes)
        out.append(" ".join(filter(None, map(block_text, runs))))
    return out


MAIN_TAGS = frozenset(("article", "main"))
BOILERPLATE_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog"))


def labelled(root: Node) -> Node:
    """Label nodes by the elements that HTML defines as main text or not.

    Where a page has main text, what lies outside and holds none is boilerplate.
    """
    order: list[Node] = []
    stack: list[tuple[Node, int | None]] = [(root, None)]
    while stack:
        node, label = stack.pop()
        if label == 0 or node.tag in BOILERPLATE_TAGS or any(t in BAD for t in node.tokens):
            label = 0
        elif node.tag in MAIN_TAGS:
            label = 1
        node.label = label
        order.append(node)
        stack.extend((c, label) for c in node.children)
    holds = {id(n) for n in order if n.label == 1}
    for node in reversed(order):
        if id(node) in holds and node.parent:
            holds.add(id(node.parent))
    if holds:
        for node in order:
            if node.label is None and id(node) not in holds:
                node.label = 0
    return root


def rebuilt(root: Node, sentences: list[str], rng: random.Random) -> Node:
    """A page with the main text of ``root`` in other markup, amid other boilerplate."""
    def element(tag: str, token: str | None, label: int | None) -> Node:
        return Node(tag, (token,) if token else (), label=label)

    def run(to: Node, data: str, linked: bool = False) -> None:
        child = to.add(Node("#text", label=to.label))
        child.parts.append(data)
        child.links = len(data) if linked else 0

    def copy(node: Node, to: Node) -> None:
        pairs = [(node, to)]
        while pairs:
            old, new = pairs.pop()
            pairs += [(c, new.add(Node(c.tag, c.tokens, label=1, parts=list(c.parts),
                                       links=c.links))) for c in old.children]

    def boilerplate(kind: int) -> Node:
        tag = ("nav", "header", "footer", "aside", "div", "div", "div", "form")[kind]
        words = sorted(w for w, i in BAD.items() if i == kind)
        plain = rng.random() < 0.6
        box = element("div" if plain and rng.random() < 0.8 else tag if not plain else "section",
                      rng.choice(words) if plain or tag == "div" else None, 0)
        if kind in (0, 2, 3) and rng.random() < 0.7:
            inner = box.add(element("ul", None, 0))
            for _ in range(rng.randint(3, 8)):
                run(inner.add(element("li", None, 0)), rng.choice(sentences)[:rng.randint(4, 24)], True)
        for _ in range(rng.randint(2, 6) if kind == 6 else rng.randint(0, 2)):
            to = box
            if kind == 6:
                to = box.add(element(rng.choice(("div", "li", "p", "article")),
                                     rng.choice(("comment", "reply", None)), 0))
            run(to.add(element("p", None, 0)), " ".join(rng.sample(sentences, min(2, len(sentences)))))
        if not box.children:
            run(box, rng.choice(sentences))
        return box

    new = Node("root")
    body = new.add(element("body", None, None))
    if rng.random() < 0.5:
        body = body.add(element("div", rng.choice(("wrapper", "container", "page", None)), None))
    plan = [rng.randrange(N_BAD) for _ in range(rng.randint(2, 6))]
    before = rng.randint(0, len(plan))
    for kind in plan[:before]:
        body.add(boilerplate(kind))
    box = element(*rng.choice((("article", None), ("main", None), ("div", "content"),
                               ("div", "article"), ("div", "post"), ("div", "entry"),
                               ("section", "story"), ("div", None))), 1)
    holder = body
    if rng.random() < 0.3:
        holder = body.add(element("main", None, None))
    holder.add(box)
    for c in _main_nodes(root):
        copy(c, box)
    if rng.random() < 0.6:
        # Boilerplate inside the article's element, between its paragraphs.
        box.label = None
        for _ in range(rng.randint(1, 3)):
            extra = boilerplate(rng.randrange(N_BAD))
            extra.parent = box
            box.children.insert(rng.randint(1, len(box.children)), extra)
    for kind in plan[before:]:
        (holder if rng.random() < 0.3 else body).add(boilerplate(kind))
    return new


def _main_nodes(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.label == 1 and node.tag != "#text":
            out.append(node)
        else:
            stack.extend(reversed(node.children))
    return out


def fit_model(sample: list[str], seed: int = 7) -> trees.Trees:
    """Boosted trees from sampled pages and their rebuilt forms."""
    rng = random.Random(seed)
    pages = [labelled(parse(p)) for p in sample]
    sentences = [t for root in pages for n in _runs(root)
                 if (t := block_text(n)) and len(t) < 400][:5000] or ["text"]
    usable = [root for root in pages if _main_nodes(root)]
    if not usable:
        usable = [labelled(parse("<article><p>" + s + "</p></article>")) for s in sentences[:50]]
        pages = usable
    xs, ys = [], []
    for root in [*pages, *(rebuilt(r, sentences, rng) for r in usable for _ in range(3))]:
        table = node_table(root)
        known = [i for i, n in enumerate(table.nodes) if n.label is not None]
        xs.append(table.x[known])
        ys.append([table.nodes[i].label for i in known])
    return trees.fit(np.vstack(xs), np.concatenate(ys).astype(float), trees=60, depth=4, rate=0.3)


def _runs(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "#text":
            yield node
        stack.extend(reversed(node.children))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    chosen = (rows.filter(F.length("html").between(1, SAMPLE_CHARS))
              .orderBy(F.xxhash64("page_id", "html"), "page_id").select("html").limit(sample))
    model = fit_model([r.html for r in chosen.collect()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            texts = [t for i in range(0, len(pages), CHUNK) for t in extract(model, pages[i:i + CHUNK])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
