"""Main-text extraction: boosted trees over DOM nodes, then hierarchical decoding.

A page is read into a tree of its block elements; inline markup melts into
the text around it. Gradient-boosted trees (Spark ML) judge for each node from its
tag, its attribute tokens, depth, siblings, and the density of its subtree,
how likely it is content. Decoding picks for all nodes at once one of three
states, container, content or dropped, of greatest total likelihood, where
below a dropped node all is dropped and below a content node no container may
stand. So no node contradicts an ancestor.

The trees are fitted to pages made here from a seed, in many layouts, whose
nodes are known to be content or not; PAGES bounds them.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = 1000
TREES = 24
DEPTH = 6
STEP = 0.5
#: Nodes that are judged in one go: pages are gathered until they have so many.
TOGETHER = 1 << 15

#: Marks content (1) and what is not (0) in the made-up pages; no feature sees it.
TRUTH = "data-truth"

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What is dropped unread up to its end tag: it is no text of a page.
CODE = {"script", "style"}
#: What holds no elements: its inside is text up to its end tag.
PLAIN = set("textarea title iframe xmp noembed noframes".split())
#: What lies in a line of text whatever its own elements are called.
FOREIGN = {"svg", "math"}
#: Blocks that cannot stand in those and end them.
LEAVES = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head li menu ol p pre table ul".split())
INLINE = FOREIGN | set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag closes when it is the innermost open block of that kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
HEADINGS = {f"h{n}" for n in range(1, 7)}
#: End tags that close nothing beyond the innermost box.
NARROW = {"p", "li", *HEADINGS}
CLOSES |= {h: {"p", *HEADINGS} for h in HEADINGS}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "td", "th", "main", "aside", "nav", "form"}

# Words of tags, classes, ids and roles that speak for a kind of node.
KINDS = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer copyright legal colophon contentinfo",
    "side": "aside sidebar side rail widget widgets complementary related recommended more popular trending",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent notice notices alert gdpr privacy popup modal overlay dialog banner message warning",
    "social": "share sharing social follow subscribe newsletter signup",
    "comment": "comment comments reply replies respond disqus discussion reader readers feedback",
    "form": "form login search searchbox button input select fieldset textarea",
    "content": "article content main post entry story text body prose page",
}
WORDS = {w: k for k, words in enumerate(KINDS.values()) for w in words.split()}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li table blockquote pre figure figcaption nav header footer aside form dl text".split()

# A tag from its `<` on. Nothing in it is tried twice, so that a page costs as much as it is long.
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_comment_end = re.compile(r"--!?>")
_attribute = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_camel = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in CODE | PLAIN}


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    kinds: set[int] = field(default_factory=set)
    hidden: bool = False
    parts: list = field(default_factory=list)  # str, (str,) for link text, Node, or None for a break
    label: int = -1


def _attributes(node: Node, raw: str) -> None:
    if not raw.strip():
        return
    for name, a, b, c in _attribute.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            node.kinds |= {WORDS[w.lower()] for w in _camel.findall(value) if w.lower() in WORDS}
        elif name == TRUTH and value in ("0", "1"):
            node.label = int(value)
        elif name == "hidden" or (name == "style" and re.search(r"display\s*+:\s*+none", value)) or (name == "aria-hidden" and value == "true"):
            node.hidden = True


class Blocks:
    """The open blocks of a page, the root first, and where each kind of them is open."""

    def __init__(self, root: Node):
        self.open = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def innermost(self, tags: set[str]) -> int:
        """Place of the innermost open block of these tags, 0 for none (the root is never closed)."""
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=0)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def push(self, node: Node) -> None:
        place = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.tag, []).append(place)
        if node.tag in SCOPES:
            self.scopes.append(place)

    def close(self, place: int) -> None:
        """Close the block at a place and all within it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPES:
                self.scopes.pop()


def parse(page: str) -> Node:
    """The tree of block elements of a page. Unclosed, misnested and unknown tags are put up with.

    The page is read once from front to back, and each block is opened and closed
    once, however deep. A tag that never ends takes the rest of the page with it.
    """
    root = Node("html", None)
    blocks = Blocks(root)
    links = foreign = at = 0
    while True:
        less = page.find("<", at)
        if raw := page[at:] if less < 0 else page[at:less]:
            blocks.open[-1].parts.append((raw,) if links else raw)
        if less < 0:
            return root
        m = _tag.match(page, less)
        if not m:
            at, said = _no_tag(page, less, foreign > 0)
            if said:
                blocks.open[-1].parts.append((said,) if links else said)
            continue
        at, tag, rest = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag in FOREIGN:
                foreign -= foreign > 0
            elif tag in INLINE:
                links -= tag == "a" and links > 0
            elif (place := _closed_by(blocks, tag)) > 0:
                blocks.close(place)
                links = foreign = 0
            elif tag == "br":
                blocks.open[-1].parts.append(None)
            continue
        alone = rest.endswith("/")
        if tag in FOREIGN:
            foreign += not alone
            continue
        if tag in CODE and not (foreign and alone):
            _, at = _raw_end(page, at, tag)
            continue
        if tag in LEAVES:
            foreign = 0
        if foreign or tag in INLINE:
            links += tag == "a"
            continue
        if tag in ("html", "body") and len(blocks.open) == 1:
            _attributes(root, rest)
            continue
        if tag in VOID:
            blocks.open[-1].parts.append(None)
            continue
        closed = CLOSES.get(tag, {"p"})
        if (place := blocks.innermost(closed)) and place >= blocks.scope():
            blocks.close(place)
        links = 0
        above = blocks.open[-1]
        new = Node(tag, above, {WORDS[tag]} if tag in WORDS and tag not in ("body", "text") else set())
        _attributes(new, rest)
        above.parts.append(new)
        if tag in PLAIN:
            end, after = _raw_end(page, at, tag)
            if end > at:
                new.parts.append(page[at:end])
            at = after
        elif not alone:
            blocks.push(new)


def _no_tag(page: str, less: int, foreign: bool) -> tuple[int, str]:
    """Where reading goes on after a `<` that opens no whole tag, and what text it stands for."""
    if page.startswith("<!--", less):
        end = _comment_end.search(page, less + 2)
        return (end.end() if end else len(page)), ""
    if foreign and page.startswith("<![CDATA[", less):
        end = page.find("]]>", less)
        return (end + 3, page[less + 9 : end]) if end >= 0 else (len(page), page[less + 9 :])
    after = page[less + 1 : less + 2]
    letter = page[less + 2 : less + 3] if after == "/" else after
    if letter.isascii() and letter.isalpha():  # a tag that never ends
        return len(page), ""
    if after in ("!", "?") or after == "/" and letter:
        end = page.find(">", less)
        return (end + 1 if end >= 0 else len(page)), ""
    return less + 1, "<"


def _raw_end(page: str, at: int, tag: str) -> tuple[int, int]:
    """Where an element that holds no elements ends, before and after its end tag; without one, with the page."""
    m = _ends[tag].search(page, at)
    if not m:
        return len(page), len(page)
    end = page.find(">", m.end())
    return m.start(), end + 1 if end >= 0 else len(page)


def _closed_by(blocks: Blocks, tag: str) -> int:
    """The place of the block that an end tag closes, 0 for none."""
    place = blocks.innermost(HEADINGS if tag in HEADINGS else {tag})
    return 0 if tag in NARROW and place < blocks.scope() else place


def _own_text(node: Node) -> None:
    """Put runs of text that stand beside blocks into nodes of their own."""
    if any(isinstance(p, Node) for p in node.parts):
        parts: list = []
        run: list = []
        for p in [*node.parts, node]:
            if isinstance(p, Node):
                if any(r and (r if isinstance(r, str) else r[0]).strip() for r in run):
                    parts.append(Node("text", node, set(), False, run, node.label))
                run = []
                if p is not node:
                    parts.append(p)
            else:
                run.append(p)
        node.parts = parts


@dataclass
class Tree:
    """A page's nodes in document order, and what the trees look at."""

    nodes: list[Node]
    parents: list[int]
    features: np.ndarray
    texts: list[str]


def survey(page: str) -> Tree:
    """Nodes, texts and features of a page."""
    nodes: list[Node] = []
    parents: list[int] = []
    stack = [(parse(page), -1)]
    while stack:
        node, parent = stack.pop()
        _own_text(node)
        here = len(nodes)
        nodes.append(node)
        parents.append(parent)
        stack += [(p, here) for p in reversed(node.parts) if isinstance(p, Node)]
    n = len(nodes)
    texts = [""] * n
    own, linked, marks, words, paragraphs, controls = ([0] * n for _ in range(6))
    for k, node in enumerate(nodes):
        whole, link = [], 0
        for p in node.parts:
            if isinstance(p, Node):
                continue
            piece = " " if p is None else entities.unescape(p if isinstance(p, str) else p[0])
            link += len(piece.strip()) if isinstance(p, tuple) else 0
            whole.append(piece)
        texts[k] = t = " ".join("".join(whole).split())
        if t:
            own[k], linked[k], words[k] = len(t), link, t.count(" ") + 1
            marks[k] = sum(map(t.count, ".,;!?"))
            paragraphs[k] = node.tag in ("p", "text", "blockquote", "pre")
        controls[k] = node.tag in ("form", "fieldset", "select", "button", "option", "textarea")
    chars, below = own.copy(), [0] * n
    children, place, depth = [0] * n, [1] * n, [0] * n
    kin: dict[tuple, int] = {}
    for k in range(1, n):
        up = parents[k]
        children[up] += 1
        place[k], depth[k] = children[up], depth[up] + 1
        kin[up, nodes[k].tag] = kin.get((up, nodes[k].tag), 0) + 1
    for k in range(n - 1, 0, -1):
        up = parents[k]
        for totals in (chars, linked, marks, words, paragraphs, controls):
            totals[up] += totals[k]
        below[up] += below[k] + 1
    kinds, tags = np.zeros((n, len(KINDS)), np.float32), np.zeros((n, len(TAGS)), np.float32)
    above = np.zeros((n, len(KINDS)), np.float32)
    for k, node in enumerate(nodes):
        if node.kinds:
            kinds[k, list(node.kinds)] = 1
        if k:
            above[k] = above[parents[k]]
        if node.kinds:
            above[k, list(node.kinds)] = 1
        tags[k, _tag_place.get(node.tag, _tag_place["div"])] = 1
    up = np.maximum(np.array(parents), 0)
    inner = np.array(parents) >= 0
    own, chars, linked, marks, words, paragraphs, controls, below, children = (
        np.array(v, float) for v in (own, chars, linked, marks, words, paragraphs, controls, below, children)
    )
    total = max(1.0, chars[0])
    nodes_in = 1 + below
    same = np.array([1] + [kin[parents[k], nodes[k].tag] for k in range(1, n)], float)
    x = np.concatenate(
        [
            np.column_stack([
                depth, np.array(place) / np.where(inner, np.maximum(1, children[up]), 1), same, np.log1p(children), np.log1p(below),
                np.log1p(chars), chars / nodes_in, linked / np.maximum(1, chars), marks / np.maximum(1, words), words / nodes_in,
                paragraphs / nodes_in, controls, chars / total, (np.cumsum(own) - own) / total, chars / np.where(inner, np.maximum(1, chars[up]), total),
                own / np.maximum(1, chars), [node.hidden for node in nodes], np.log1p(paragraphs), inner * linked[up] / np.maximum(1, chars[up]),
                inner * (words / nodes_in)[up], inner * (paragraphs / nodes_in)[up],
            ]).astype(np.float32), kinds, above, tags,
        ],
        axis=1,
    )
    return Tree(nodes, parents, x, texts)


_tag_place = {tag: place for place, tag in enumerate(TAGS)}
N_FEATURES = 21 + 2 * len(KINDS) + len(TAGS)


@dataclass
class Forest:
    """Trees as arrays: for each node its feature (-1: leaf), threshold, children and value."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Forest:
        def flat(node) -> tuple:
            rows: list[list] = []

            def walk(n) -> int:
                here = len(rows)
                rows.append([-1, 0.0, 0, 0, float(n.prediction())])
                if n.getClass().getSimpleName() == "InternalNode":
                    rows[here][:2] = [int(n.split().featureIndex()), float(n.split().threshold())]
                    rows[here][2] = walk(n.leftChild())
                    rows[here][3] = walk(n.rightChild())
                return here

            walk(node)
            return tuple(np.array(c) for c in zip(*rows, strict=True))

        return cls([flat(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights))

    def likely(self, x: np.ndarray) -> np.ndarray:
        """How likely the rows of x are content."""
        total = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def decode(tree: Tree, likely: np.ndarray) -> list[bool]:
    """Which nodes are content in the most likely labelling without contradictions.

    Best totals are summed from the leaves up: of a node as container (costing
    as much as a coin toss), as content, and as dropped. Nodes count by their text.
    """
    p = np.clip(likely, 0.01, 0.99)
    keep, drop, toss = np.log(p), np.log(1 - p), np.log(0.5)
    n = len(p)
    container, content, dropped = np.full(n, toss), keep.copy(), drop.copy()
    for k in range(n - 1, -1, -1):
        if tree.texts[k]:
            container[k] += 4 * toss  # text directly in a container is lost
        if (up := tree.parents[k]) >= 0:
            container[up] += max(container[k], content[k], dropped[k])
            content[up] += max(content[k], dropped[k])
            dropped[up] += dropped[k]
    state = [2] * n
    for k in range(n):
        above = state[tree.parents[k]] if k else 0
        choices = {0: (container[k], content[k], dropped[k]), 1: (-np.inf, content[k], dropped[k]), 2: (-np.inf, -np.inf, 0.0)}[above]
        state[k] = int(np.argmax(choices))
    return [s == 1 for s in state]


def main_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """Of each page the content blocks in order, joined by one space; empty for a null or empty page."""
    out: list[str] = []
    waiting: list[Tree] = []

    def judge() -> None:
        x = np.concatenate([t.features for t in waiting])
        likely = np.concatenate([forest.likely(x[k : k + TOGETHER]) for k in range(0, len(x), TOGETHER)])
        ends = np.cumsum([len(t.nodes) for t in waiting])
        for tree, of in zip(waiting, np.split(likely, ends[:-1]), strict=True):
            out.append(" ".join(t for t, c in zip(tree.texts, decode(tree, of), strict=True) if c and t))
        waiting.clear()

    for page in pages:
        waiting.append(survey(page or ""))
        if sum(len(t.nodes) for t in waiting) >= TOGETHER:
            judge()
    if waiting:
        judge()
    return out


def extract(pages: DataFrame, forest: Forest, html: str = "html") -> DataFrame:
    """Add `text`, the main text of each page, to every row.

    Null and empty pages have an empty text, as have pages without content.
    Very long pages are read whole. A column `text` of `pages` is replaced, all
    others pass through unread; repeated rows get equal texts. An empty table gives
    no rows.
    """
    kept = pages.select(*[c for c in pages.columns if c.lower() != "text"], F.lit("").alias("text"))
    shared = pages.sparkSession.sparkContext.broadcast(forest)  # TREES trees of 2 ** DEPTH leaves

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(main_texts(batch[html].to_pylist(), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema=batch.schema)

    return kept.mapInArrow(extracted, kept.schema)


_forests: dict[tuple, Forest] = {}


def train(spark: SparkSession, pages: int = PAGES, seed: int = 11) -> Forest:
    """Trees fitted to the nodes of made-up pages; kept for the life of the driver."""
    if (key := (pages, seed)) not in _forests:
        trees = [survey(page) for page in made_pages(pages, seed)]
        label, x = np.concatenate([labels(t) for t in trees]), np.concatenate([t.features for t in trees]).astype(float)
        known = pa.table({"label": label[label >= 0].astype(float), "x": pa.FixedSizeListArray.from_arrays(x[label >= 0].ravel(), N_FEATURES).cast(pa.list_(pa.float64()))})
        data = spark.createDataFrame(known).select("label", array_to_vector("x").alias("features")).coalesce(1).cache()
        _forests[key] = Forest.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=STEP).fit(data))
        data.unpersist()
    return _forests[key]


def labels(tree: Tree) -> list[int]:
    """1 in marked content, 0 elsewhere, -1 for what is not content but contains some."""
    out: list[int] = []
    for node, up in zip(tree.nodes, tree.parents, strict=True):
        out.append(node.label if node.label >= 0 else max(0, out[up]) if up >= 0 else 0)
    for k in range(len(out) - 1, 0, -1):
        if out[k] != 0 and out[tree.parents[k]] == 0:
            out[tree.parents[k]] = -1
    return out


def made_pages(n: int, seed: int) -> Iterator[str]:
    """Pages in many layouts, with TRUTH marked."""
    draw = random.Random(seed)
    syllables = "an er in on st re th ti ou la de mi ra so el qu ver ung che tion".split()

    def words(low: int, high: int) -> str:
        n = draw.randint(low, high)
        out = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) + draw.choices(["", ",", "."], [12, 1, 1])[0] for _ in range(n)]
        return " ".join(out).capitalize()

    def some(options: list[str], low: int = 0, high: int = 2) -> str:
        return "".join(draw.choices(options, k=draw.randint(low, high)))

    def named(*names: str) -> str:
        """A class or id of one of these names, now and then with others around it."""
        extra = draw.choice(["", "", " c%d" % draw.randint(1, 99), " wide", "-inner", " col-%d" % draw.randint(1, 12)])
        return f' {draw.choice(["class", "class", "id"])}="{draw.choice(names)}{extra}"'

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(draw.randint(low, high)))

    def menu() -> str:
        body = f"<ul>{links(3, 9)}</ul>"
        loose = " | ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(draw.randint(3, 8)))
        return draw.choice(
            [f"<nav>{body}</nav>", f"<nav{named('main-menu', 'navbar')}>{body}</nav>", f"<div{named('menu', 'nav', 'navigation', 'breadcrumb')}>{body}</div>", f"<div>{loose}</div>", f"<ul{named('nav', 'menu', 'tabs')}>{links(3, 8)}</ul>"]
        )

    def unseen(part: str, chance: float) -> str:
        """Now and then the part with a mark that browsers do not show it."""
        mark = draw.choice([" hidden", ' style="display:none"', ' aria-hidden="true"'])
        return re.sub(r"^<(\w+)", rf"<\1{mark}", part) if draw.random() < chance else part

    def head() -> str:
        inside = f"<h2>{words(1, 4)}</h2>" + some([f"<p>{words(3, 9)}</p>", menu()], 0, 2)
        return draw.choice([f"<header>{inside}</header>", f"<div{named('header', 'masthead', 'topbar', 'banner')}>{inside}</div>"])

    def ad() -> str:
        inside = draw.choice([words(5, 40), f"<p>{words(5, 30)}</p>", f'<a href="/buy">{words(3, 9)}</a> {words(3, 20)}'])
        tag = draw.choice(["div", "div", "aside", "section", "p"])
        return f"<{tag}{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-box', 'adBanner')}>{inside}</{tag}>"

    def notice() -> str:
        inside = f"<p>{words(8, 40)}</p>" + draw.choice(["", f"<button>{words(1, 2)}</button>"])
        return f"<div{named('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'warning')}>{draw.choice([inside, words(8, 40)])}</div>"

    def side() -> str:
        inside = f"<h3>{words(1, 3)}</h3>" + draw.choice([f"<ul>{links(3, 8)}</ul>", f"<p>{words(8, 50)}</p>", f"<p>{words(8, 30)}</p><p>{words(8, 30)}</p>"])
        return draw.choice([f"<aside>{inside}</aside>", f"<div{named('sidebar', 'side', 'widget', 'related', 'recommended', 'popular')}>{inside}</div>"])

    def comments() -> str:
        one = "".join(f"<{t}{named('comment', 'reply')}><b>{words(1, 2)}</b><p>{words(5, 60)}</p></{t}>" for t in draw.choices(["div", "li", "article"], k=draw.randint(1, 5)))
        plain = "".join(f"<p>{words(5, 50)}</p>" for _ in range(draw.randint(1, 4)))
        tag = draw.choice(["div", "section", "ol", "aside"])
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses comments', 'disqus', 'reader-comments')}><h3>{words(1, 3)}</h3>{draw.choice([one, one, plain])}</{tag}>"

    def form() -> str:
        inside = f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>" + draw.choice(["", f"<p>{words(4, 20)}</p>", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>"])
        return draw.choice([f"<form>{inside}</form>", f"<div{named('newsletter', 'subscribe', 'signup', 'login', 'search')}><form>{inside}</form></div>"])

    def share() -> str:
        return f"<div{named('share', 'social', 'sharing', 'follow')}>{draw.choice([words(1, 8), f'<ul>{links(2, 5)}</ul>'])}</div>"

    def foot() -> str:
        inside = draw.choice([f"&copy; {words(3, 25)}", f"<p>&copy; {words(3, 25)}</p>", f"<ul>{links(2, 6)}</ul><p>{words(3, 20)}</p>"])
        return draw.choice([f"<footer>{inside}</footer>", f"<div{named('footer', 'copyright', 'legal', 'site-footer')}>{inside}</div>"])

    def rich(low: int, high: int) -> str:
        return draw.choice(
            [words(low, high), words(low, high), f"<b>{words(low, high)}", f'{words(low, high)} <a href="/y">{words(1, 3)}</a> {words(2, 9)}', f"<i>{words(2, 5)}</i> {words(low, high)}", f"{words(low, high)}<br>{words(2, 9)}"]
        )

    def block() -> str:
        kind = draw.choices(["p", "open", "h", "list", "quote", "table", "pre", "figure", "div"], [24, 8, 4, 3, 2, 2, 1, 1, 3])[0]
        if kind == "list":
            return f"<{(t := draw.choice(['ul', 'ol']))}>" + "".join(f"<li>{rich(2, 25)}</li>" for _ in range(draw.randint(2, 6))) + f"</{t}>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr>" for _ in range(draw.randint(2, 5))) + "</table>"
        return {
            "p": f"<p>{rich(4, 120)}</p>", "open": f"<p>{rich(4, 90)}", "h": f"<h{draw.randint(2, 4)}>{words(1, 8)}</h2>", "quote": f"<blockquote><p>{words(5, 40)}</p></blockquote>",
            "pre": f"<pre>{words(5, 30)}</pre>", "figure": f'<figure><img src="a"><figcaption>{words(3, 15)}</figcaption></figure>', "div": f"<div>{rich(5, 80)}</div>",
        }[kind]

    def article() -> str:
        inside = draw.choice(["", f"<h1>{words(2, 14)}</h1>"])
        for _ in range(draw.choice([1, 1, 2, 4, 7, 12])):
            inside += unseen(block(), 0.02)
            if draw.random() < 0.12:
                extra = unseen(draw.choice([ad, share, side, form, notice, menu])(), 0.2)
                inside += re.sub(r"^<(\w+)", rf'<\1 {TRUTH}="0"', extra)
        mark = f' {TRUTH}="1"'
        return draw.choice(
            [f"<article{mark}>{inside}</article>", f"<article{mark}>{inside}</article>", f"<main{mark}>{inside}</main>", f"<main><article{mark}>{inside}</article>%s</main>" % draw.choice(["", comments(), side()]),
             f"<div{named('content', 'main-content', 'post', 'post-body', 'entry-content', 'story', 'article-text')}{mark}>{inside}</div>", f"<section{named('story', 'content', 'post')}{mark}>{inside}</section>",
             f'<div role="main"{mark}>{inside}</div>', f"<div{mark}>{inside}</div>", f"<div class=wrap><div{named('content', 'main')}><div{mark}>{inside}</div>{some([share(), side()], 0, 1)}</div></div>"]
        )

    def loose() -> str:
        """Content that stands in the body without an element of its own."""
        mark = f' {TRUTH}="1"'
        blocks = [re.sub(r"^<(\w+)", rf"<\1{mark}", block()) for _ in range(draw.choice([1, 3, 6]))]
        return "".join(b for b in blocks if b.startswith("<"))

    def outside(parts: list[Callable[[], str]], low: int, high: int) -> str:
        return "".join(unseen(draw.choice(parts)(), 0.1) for _ in range(draw.randint(low, high)))

    for _ in range(n):
        if draw.random() < 0.02:
            yield f'<html {TRUTH}="1"><body>{draw.choice([words(5, 200), article()])}</body></html>'
            continue
        if draw.random() < 0.04:  # a page, or a piece of one, without an article
            yield f"<html><body>{outside([menu, menu, head, ad, notice, form, side, share, foot], 1, 4)}</body></html>"
            continue
        top = outside([menu, head, ad, notice, form], 1, 4)
        low = outside([side, comments, share, form, ad, notice, comments], 0, 3)
        body = top + (article() if draw.random() < 0.88 else loose()) + low + draw.choice([foot(), foot(), ""])
        if draw.random() < 0.3:
            body = f"<div{draw.choice(['', named('page', 'wrapper', 'container')])}>{body}</div>"
        yield f"<html><head><title>{words(2, 6)}</title><script>var a='</p>';</script></head><body>{body}</body></html>"
