"""HTML extraction by a tree-structured graphical model.

A page's block elements form a tree; each is main text or not. Node potentials come
from tag, names in class, id and role, links and length; potentials between parent
and child depend on what the parent's names say. Sum-product messages upward and
downward give every block's marginal, and the text of blocks with a marginal of at
least one half is kept, in page order. The weights are fitted on labelled pages by
the gradient of the likelihood, which needs the same marginals.

Defined results: a null or empty html has no text. A page without block elements is one
block, with nothing around it to tell it from, and its text is kept. A page cut off
inside a tag loses the piece of the tag, one cut off inside an element keeps its text,
unless it is a script, style, text field or title; br is white space. Unknown end tags
are passed over. Repeated rows get the same result each, an empty table an empty result.
"""

from __future__ import annotations

import html as entities
import math
from bisect import bisect
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import small_arrow_batches, table
from lapwing.llm.html_pages import labelled_pages

_TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", regex.S)
#: Fixed groups of HTML elements.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "select", "video", "audio", "canvas"}
#: Of these, the ones that reach to the page's end where they aren't closed.
_TO_THE_END = {"script", "style", "textarea", "title"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_BOUNDS = {"ul", "ol", "dl", "table", "menu"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Fixed names in class, id and role, by what they tell.
_NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination topbar toolbar tabs",
    "ad": "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion commercial",
    "side": "sidebar side aside widget widgets related recommended recommendations more trending popular",
    "foot": "footer foot copyright legal imprint colophon",
    "head": "header masthead logo branding",
    "comment": "comment comments reply replies respond discussion disqus reader",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay warning banner disclaimer",
    "form": "form search login signin signup register newsletter subscribe subscription contact",
    "share": "share sharing social follow tags meta",
    "main": "article content post entry story main body text page",
}
_NAME_OF = {w: k for k, words in _NAMES.items() for w in words.split()}
_CUES = ("menu", "ad", "side", "foot", "head", "comment", "notice", "form", "share")
_TAG_CUE = {"nav": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "dialog": "notice", "search": "form", "menu": "menu", "article": "main", "main": "main"}
_SPLIT = regex.compile(r"[^a-z]+")
_ATTR = regex.compile(r"""\b(class|id|role|hidden|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", regex.I)


class Node:
    __slots__ = ("chars", "children", "kind", "label", "linked", "name", "parent", "tag")

    def __init__(self, tag: str, parent: int, name: str, label: int):
        self.tag, self.parent, self.name, self.label = tag, parent, name, label
        self.chars = self.linked = 0


def _named(attrs: str) -> tuple[str, str | None]:
    name, mark = "", None
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "data-y":
            mark = value
        elif key == "hidden":
            name = "notice"
        else:
            for w in _SPLIT.split(value.lower()):
                k = _NAME_OF.get(w)
                if k and (not name or name == "main"):
                    name = k
    return name, mark


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes (parents first) and the blocks of text, each with its node."""
    nodes = [Node("body", -1, "", 0)]
    stack, texts, run = [0], [], []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, outermost first
    unclosed: set[str] = set()
    anchors = own = 0

    def cut(at: int):
        """Close what is open from a place of the stack on; each entry is closed once."""
        for k in stack[at:]:
            places[nodes[k].tag].pop()
        del stack[at:]

    def flush():
        nonlocal run
        if run:
            text = " ".join("".join(run).split())
            if text:
                texts.append((own, text))
            run = []

    def add(piece: str):
        if not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        run.append(piece)
        if not piece.isspace():
            node = nodes[own]
            node.chars += len(piece)
            node.linked += len(piece) * (anchors > 0)

    hidden = 0
    pos = 0
    while True:
        m = _TAG.search(page, pos)
        if m is None:
            if not hidden:
                add(page[pos:])
            break
        if not hidden:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            if tag == "head":
                hidden = 0
            elif tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCKS and tag not in ("body", "html"):
                flush()
                if places.get(tag):
                    cut(places[tag][-1])
                    own = stack[-1]
                    anchors = 0
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                end = None if tag in unclosed else regex.compile(rf"</{regex.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", regex.I).search(page, pos)
                if end or tag in _TO_THE_END:
                    pos = end.end() if end else len(page)
                else:
                    unclosed.add(tag)
            run.append(" ")
        elif tag == "head":
            hidden = 1
        elif tag == "body":
            hidden = 0
            flush()
        elif tag in ("br", "wbr", "hr", "img", "input"):
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
        elif tag == "a":
            anchors += not attrs.rstrip().endswith("/")
        elif tag in _BLOCKS and tag != "html":
            hidden = 0
            flush()
            anchors = 0
            if nodes[stack[-1]].tag == "p" or (tag in _HEADINGS and nodes[stack[-1]].tag in _HEADINGS):
                cut(len(stack) - 1)
            shut = _CLOSES.get(tag)
            if shut:
                bound = max((places[b][-1] for b in _BOUNDS if places.get(b)), default=0)
                inside = [places[x][k] for x in shut if places.get(x) and (k := bisect(places[x], bound)) < len(places[x])]
                if inside:
                    cut(min(inside))
            name, mark = _named(attrs) if attrs else ("", None)
            parent = stack[-1]
            nodes.append(Node(tag, parent, name, nodes[parent].label if mark is None else int(mark)))
            own = len(nodes) - 1
            places.setdefault(tag, []).append(len(stack))
            stack.append(own)
    flush()
    return nodes, texts


#: What a node's cue does to the potentials between it and its children.
def _edge_kind(node: Node) -> int:
    cue = node.name or _TAG_CUE.get(node.tag, "")
    return 0 if not cue else 2 if cue == "main" else 1


def features(nodes: list[Node]) -> list[list[int]]:
    """Indices of each node's features; ``_INDEX`` names them."""
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        chars[p] += chars[k]
        linked[p] += linked[k]
    out = []
    for k, n in enumerate(nodes):
        f = [_INDEX["bias"], _INDEX.get("tag " + n.tag, _INDEX["tag other"])]
        if n.name:
            f.append(_INDEX["name " + n.name])
        share = linked[k] / chars[k] if chars[k] else 0
        f.append(_INDEX["empty" if not chars[k] else "linked" if share > 0.6 else "mixed" if share > 0.25 else "plain"])
        if chars[k]:
            f.append(_INDEX["short" if chars[k] < 40 else "middle" if chars[k] < 200 else "long"])
        out.append(f)
    return out


_INDEX = {k: i for i, k in enumerate(["bias", "empty", "linked", "mixed", "plain", "short", "middle", "long", "tag other", *("tag " + t for t in sorted(_BLOCKS - {"html", "head"})), *("name " + k for k in _NAMES)])}
_EDGES = 3 * 4


def marginals(nodes: list[Node], scores: list[float], edges: list[float]) -> tuple[list[float], list[tuple]]:
    """P(main) of each node, and of each node with a parent P(parent, own) for the four cases.

    ``scores`` are log potentials of being main; ``edges`` holds exp of the potentials
    of (kind of parent, parent's state, own state).
    """
    n = len(nodes)
    off, on = [1.0] * n, [math.exp(max(-30.0, min(30.0, s))) for s in scores]
    up0, up1 = [1.0] * n, [1.0] * n
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[k].parent
        e = 4 * nodes[p].kind
        total = off[k] + on[k]
        a, b = off[k] / total, on[k] / total
        off[k], on[k] = a, b
        x, y = edges[e] * a + edges[e + 1] * b, edges[e + 2] * a + edges[e + 3] * b
        up0[k], up1[k] = x, y
        x, y = off[p] * x, on[p] * y
        off[p], on[p] = x / (x + y), y / (x + y)
    total = off[0] + on[0]
    result, joint = [on[0] / total] * n, [()] * n
    for k in range(1, n):
        p = nodes[k].parent
        e = 4 * nodes[p].kind
        q1 = result[p]
        # what the parent knows without this child
        c0, c1 = (1 - q1) / up0[k], q1 / up1[k]
        a, b, c, d = c0 * edges[e] * off[k], c0 * edges[e + 1] * on[k], c1 * edges[e + 2] * off[k], c1 * edges[e + 3] * on[k]
        total = a + b + c + d
        result[k] = (b + d) / total
        joint[k] = (a / total, b / total, c / total, d / total)
    return result, joint


def judge(nodes: list[Node], weights: tuple) -> list[float]:
    w, edges = weights
    for n in nodes:
        n.kind = _edge_kind(n)
    return marginals(nodes, [sum([w[i] for i in f]) for f in features(nodes)], [math.exp(x) for x in edges])[0]


@lru_cache(maxsize=1)
def trained(pages: int = 120, rounds: int = 120, rate: float = 4.0, decay: float = 1e-3) -> tuple:
    """Weights of node features and of edges, fitted on labelled pages by gradient ascent."""
    data = []
    for page in labelled_pages(pages):
        nodes, _ = parse(page)
        for n in nodes:
            n.kind = _edge_kind(n)
        data.append((nodes, features(nodes)))
    total = sum(len(nodes) for nodes, _ in data)
    w, edges = [0.0] * len(_INDEX), [0.0] * _EDGES
    gw, ge = [0.0] * len(w), [0.0] * _EDGES
    for _ in range(rounds):
        gw, ge = [0.5 * g for g in gw], [0.5 * g for g in ge]
        shown = [math.exp(x) for x in edges]
        for nodes, feats in data:
            result, joint = marginals(nodes, [sum([w[i] for i in f]) for f in feats], shown)
            for k, n in enumerate(nodes):
                d = (n.label - result[k]) / total
                for i in feats[k]:
                    gw[i] += d
                if k:
                    e = 4 * nodes[n.parent].kind
                    for s, x in enumerate(joint[k]):
                        ge[e + s] -= x / total
                    ge[e + 2 * nodes[n.parent].label + n.label] += 1 / total
        w = [x + rate * (g - decay * x) for x, g in zip(w, gw, strict=True)]
        edges = [x + rate * (g - decay * x) for x, g in zip(edges, ge, strict=True)]
    return w, edges


def main_text(page: str | None, weights: tuple) -> str:
    nodes, texts = parse(page or "")
    if not texts:
        return ""
    if len(nodes) == 1:
        return "\n".join(text for _, text in texts)
    keep = judge(nodes, weights)
    return "\n".join(text for k, text in texts if keep[k] >= 0.5)


def extract(pages: DataFrame, weights: tuple | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = weights or trained()
    small_arrow_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit(""))).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
