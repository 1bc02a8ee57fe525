"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label, content or not. Its tag, class, id and role words, text length, link share
and punctuation give its own potential; parent and child share one by the child's kind of element. Both are fitted by
maximum likelihood on labelled pages (labelled_pages.py). For a page, sum-product messages pass upward from the leaves
and downward from the root; the two together are exact marginals, as the graph is a tree. Text whose element is more
likely content than not is kept, block by block, with white space collapsed and character references decoded.

Nulls: a null or empty page has an empty text; null ids and urls are kept. Broken markup is read leniently: unclosed
elements end with their parents, stray end tags are passed over. Pages are read whole, whatever their size. Repeated
rows get the same text. An empty table gives an empty result. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orthoplan.llm import labelled_pages

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's void elements, elements that are passed over with all they hold, inline elements, and what ends an open element.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "template", "iframe", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "button", "select", "option", "object", "canvas", "audio", "video", "svg", "g", "text", "tspan", "math", "semantics", "annotation", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mpadded", "mphantom", "merror", "menclose"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
KEEPS = {"ul", "ol", "table", "dl", "select", "body", "html", "article", "section", "main", "div", "aside", "nav", "form"}
IN_HEAD = {"html", "head", "body", "title", "meta", "link", "style", "script", "base", "noscript", "template"}
NO_TEXT = {"head", "select", "option", "button", "label", "datalist", "optgroup", "legend"}
GROUPS = {t: i for i, ts in enumerate([["p", "blockquote", "pre"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "dl", "li", "dd", "dt"], ["table", "tbody", "thead", "tr", "td", "th"], ["div"], ["article", "main"], ["section", "figure", "figcaption"], ["nav", "header", "footer", "aside", "form", "dialog"]]) for t in ts}
N_GROUPS = 10
PARAGRAPHS = {"p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
BREAK = -1


@dataclass
class Tree:
    """A page: for each node its parent, tag and attribute words; the text pieces in page order, BREAK between blocks."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parsed(page: str) -> Tree:
    t = Tree()
    stack: list[int] = []

    def push(tag: str, names: str, at: int) -> None:
        t.parent.append(stack[-1] if stack else -1)
        t.tag.append(tag)
        t.names.append(names)
        t.place.append(at)
        stack.append(len(t.tag) - 1)

    push("#page", "", 0)
    pos, size, opened = 0, len(page), {"#page": 1}

    def pop(to: int) -> None:
        while len(stack) > to:
            opened[t.tag[stack.pop()]] -= 1

    def body() -> None:
        """As browsers do, html and body are there even if their tags are not."""
        if not opened.get("body"):
            pop(1)
            for tag in ("html", "body"):
                push(tag, "", pos)
                opened[tag] = 1

    while pos < size:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                if not opened.get("body") and not m[0].isspace():
                    body()
                t.pieces.append((stack[-1], m[0]))
            elif m[0].startswith("<![CDATA["):
                t.pieces.append((stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            t.pieces.append((BREAK, ""))
        if m[1] or m[4]:
            if opened.get(tag) and tag not in ("body", "html"):
                k = len(stack) - 1
                while t.tag[stack[k]] != tag:
                    k -= 1
                pop(k)
            continue
        rest = m[3] if m[2] else m[6]
        if tag in ("html", "body", "head") and (opened.get(tag) or opened.get("body")):
            continue
        if tag == "body":
            pop(2 if opened.get("html") else 1)
        elif tag not in IN_HEAD:
            body()
        if tag not in INLINE and opened.get("p") and tag not in RAW and tag != "br":
            k = len(stack) - 1
            while k and t.tag[stack[k]] != "p" and t.tag[stack[k]] not in KEEPS:
                k -= 1
            if t.tag[stack[k]] == "p":
                pop(k)
        if ends := CLOSES.get(tag):
            k = len(stack) - 1
            low = None
            while k and t.tag[stack[k]] not in (KEEPS - {"div"} if tag in ("li", "dt", "dd") else {"table"}):
                if t.tag[stack[k]] in ends:
                    low = k
                k -= 1
            if low is not None:
                pop(low)
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest)) if "=" in rest else ""
        push(tag, names, m.start())
        opened[tag] = opened.get(tag, 0) + 1
        if tag in VOID:
            pop(len(stack) - 1)
    return t


STEMS = sorted({w for names in labelled_pages.BOILERPLATE.values() for n in names for w in WORD.findall(n)} | {w.lower() for n in labelled_pages.CONTENT_CLASSES for w in WORD.findall(n)} | set(labelled_pages.ROLES.values()) - {""})


def features(t: Tree) -> list[list[str]]:
    """Names of the features that each node has."""
    n = len(t.tag)
    text, linked, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    own, direct, holds = np.zeros(n), np.zeros(n), [False] * n
    is_link = [False] * n
    for v in range(1, n):
        is_link[v] = t.tag[v] == "a" or is_link[t.parent[v]]
    for v, s in t.pieces:
        if v >= 0 and (size := len(s.strip())):
            text[v] += size
            own[v] += size
            linked[v] += size * is_link[v]
            marks[v] += s.count(".") + s.count(",")
    for v in range(n - 1, 0, -1):
        p = t.parent[v]
        text[p] += text[v]
        linked[p] += linked[v]
        marks[p] += marks[v]
        if t.tag[v] in PARAGRAPHS:
            direct[p] += text[v]
        holds[p] = holds[p] or holds[v] or t.tag[v] in ("article", "main")
    out = []
    for v in range(n):
        tag = t.tag[v]
        f = ["bias", "tag:" + tag, f"links:{int(4 * linked[v] / text[v]) if text[v] else 'none'}"]
        if tag not in PARAGRAPHS and tag not in INLINE:  # how long a paragraph is says nothing about the page's other ones
            f.append(f"text:{min(11, int(np.log2(text[v] + 1)))}")
            f.append(f"marks:{min(3, int(np.log2(marks[v] + 1)))}")
            f.append(f"direct:{min(9, int(np.log2(direct[v] + own[v] + 1)))}")
            f.append(f"most:{int(3.9 * (direct[v] + own[v]) / text[v]) if text[v] else 'none'}")
            f.append(f"of page:{int(3.9 * text[v] / text[0]) if text[0] else 'none'}")
            if holds[v]:
                f.append(f"holds:{tag}")
        if t.parent[v] >= 0:
            f.append(f"under:{t.tag[t.parent[v]]}")
        if names := t.names[v]:
            words = {w.lower() for w in WORD.findall(names)}
            f += ["word:" + w for w in words]
            f += ["stem:" + s for s in STEMS if len(s) > 3 and s not in words and s in names.lower()]
        out.append(f)
    return out


def kinds(t: Tree) -> list[int]:
    return [GROUPS.get(x, N_GROUPS - 1 if x in INLINE else N_GROUPS - 2) for x in t.tag]


@dataclass
class Forest:
    """Many trees as arrays, nodes by page and depth first; parents point into the same arrays."""

    parent: np.ndarray
    group: np.ndarray
    levels: list[np.ndarray]
    rows: np.ndarray
    ids: np.ndarray


def forest(trees: list[Tree], number: dict[str, int]) -> Forest:
    parent, group, depth, rows, ids = [], [], [], [], []
    base = 0
    for t in trees:
        for v, p in enumerate(t.parent):
            depth.append(depth[base + p] + 1 if p >= 0 else 0)
            parent.append(base + p if p >= 0 else -1)
        group += kinds(t)
        for v, names in enumerate(features(t)):
            known = [i for x in names if (i := number.get(x)) is not None]
            ids += known
            rows += [base + v] * len(known)
        base += len(t.tag)
    d = np.array(depth, np.int64)
    order = np.argsort(d, kind="stable")
    cuts = np.searchsorted(d[order], np.arange(1, (d.max() if len(d) else 0) + 2))
    return Forest(np.array(parent, np.int64), np.array(group, np.int64), np.split(order, cuts)[:-1], np.array(rows, np.int64), np.array(ids, np.int64))


@dataclass
class Model:
    number: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray  # group x parent's label x child's label, in logs


def marginals(f: Forest, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: each node's label distribution and, for all but roots, that of (parent's label, own label)."""
    n = len(f.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(f.rows, weights[f.ids], minlength=n)
    message = np.zeros((n, 2))
    for level in f.levels[:0:-1]:
        s = pair[f.group[level]] + up[level][:, None, :]
        message[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        np.add.at(up, f.parent[level], message[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        outside = down[p] + up[p] - message[level]
        s = outside[:, :, None] + pair[f.group[level]]
        down[level] = np.logaddexp(s[:, 0, :], s[:, 1, :])
        down[level] -= down[level].max(axis=1, keepdims=True)
        j = s + up[level][:, None, :]
        j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
        joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
    belief = up + down
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True), joint


def labelled(seed: int) -> tuple[Tree, np.ndarray]:
    pieces = labelled_pages.page(seed)
    t = parsed("".join(x for x, _ in pieces))
    starts = np.cumsum([0] + [len(x) for x, _ in pieces])
    piece = np.searchsorted(starts, t.place, side="right") - 1
    y = np.array([pieces[min(i, len(pieces) - 1)][1] for i in piece])
    y[0] = False
    return t, y


@functools.lru_cache(maxsize=2)
def trained(pages: int = 800, steps: int = 300, decay: float = 0.0005) -> Model:
    """Maximum likelihood on generated labelled pages, by gradient steps with momentum and per-weight scale."""
    examples = [labelled(s) for s in range(pages)]
    counts: dict[str, int] = {}
    for t, _ in examples:
        for names in features(t):
            for x in names:
                counts[x] = counts.get(x, 0) + 1
    number = {x: i for i, x in enumerate(sorted(x for x, c in counts.items() if c >= 3))}
    f = forest([t for t, _ in examples], number)
    y = np.concatenate([y for _, y in examples]).astype(int)
    child = np.concatenate(f.levels[1:])
    k = len(number)
    seen = np.zeros((N_GROUPS, 2, 2))
    np.add.at(seen, (f.group[child], y[f.parent[child]], y[child]), 1)
    theta, m, v = np.zeros(k + seen.size), np.zeros(k + seen.size), np.zeros(k + seen.size)
    for step in range(1, steps + 1):
        own, joint = marginals(f, theta[:k], theta[k:].reshape(seen.shape))
        expected = np.zeros_like(seen)
        np.add.at(expected, f.group[child], joint[child])
        g = np.concatenate([np.bincount(f.ids, (y - own[:, 1])[f.rows], minlength=k), (seen - expected).ravel()]) - decay * len(examples) / 100 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(number, theta[:k], theta[k:].reshape(seen.shape))


def main_texts(model: Model, pages: list[str | None]) -> list[str]:
    trees = [parsed(p or "") for p in pages]
    content = marginals(forest(trees, model.number), model.weights, model.pair)[0][:, 1] >= 0.5 if trees else []
    out, base = [], 0
    for t in trees:
        hidden = [False] * len(t.tag)
        for v in range(1, len(t.tag)):
            hidden[v] = hidden[t.parent[v]] or t.tag[v] in NO_TEXT
        blocks, block = [], []
        for v, s in [*t.pieces, (BREAK, "")]:
            if v == BREAK:
                if block:
                    blocks += html.unescape("".join(block)).split()
                    block = []
            elif content[base + v] and not hidden[v]:
                block.append(s)
        out.append(" ".join(blocks))
        base += len(t.tag)
    return out


def extracted(pages: DataFrame, model: Model | None = None, portion: int = 64) -> DataFrame:
    """pages(html, ...) -> the other columns + text, n_chars (code points)."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())  # some hundred features, whatever the pages
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    d = pages.select("html", *kept)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, portion):
                part = b.slice(at, portion)
                texts = main_texts(held.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*kept, "text", "n_chars"])

    return d.mapInArrow(rows, StructType([*d.schema.fields[1:], StructField("text", StringType()), StructField("n_chars", LongType())]))
