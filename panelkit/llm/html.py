"""Main-text extraction with a tree-structured graphical model.

Every block element of a page is a node with a hidden label, content or
boilerplate.  A node's own features (element kind, length and link share of
its own text) give its unary potential, and the edge to its parent gives a
pairwise potential that depends on the node's name type: named like
boilerplate, below such a name, named like content, or none of these.
Sum-product message passing, once up and once down the tree, yields each
node's marginal; the text runs of nodes more likely content than not are the
result.

Both potentials are learned from labelled pages: pages that mark their
article.  Nodes inside an ``article`` or ``main`` element and not at or below a
boilerplate name are content.  Such a page is counted twice, as it is and with
its marks hidden (``article`` and content names taken as plain blocks), which
gives the pairwise potentials of pages without marks, where content has to
show by its text.  The learner sees about ``LABELLED_PAGES`` hash-chosen pages
as distributed counts of (features, label) and of (marked, type, parent label,
label), a table whose size does not depend on the input.

Names are words of class, id and role, and element names.  Inside a marked
article only element names and whole class or role tokens count, and headings
have no name: ``<section id="related-work">`` is part of the article.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.words import slices

LABELLED_PAGES = 5000
# Element kinds and name words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript svg math canvas iframe object title textarea select".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul caption button label".split())
BOILER = frozenset(
    "nav navbar navigation menu menubar footer header aside sidebar ad ads advert adverts advertisement banner "
    "sponsor sponsored promo promotion form newsletter subscribe signup login search cookie cookies consent notice "
    "notices alert popup modal overlay comment comments reply replies disqus share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager copyright legal widget toolbar button dialog tags masthead skip".split())
CONTENT = frozenset("article main content post entry story".split())
KINDS = {"p": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "ul": 2, "ol": 2, "li": 3,
         "div": 4, "section": 4, "article": 4, "main": 4, "blockquote": 5, "pre": 5, "td": 6, "tr": 6, "table": 6}
N_KINDS, N_LENGTHS, N_LINKS = 8, 5, 3
N_FEATURES = N_KINDS + N_LENGTHS + N_LINKS + 1
NEUTRAL, BOILERPLATE, MARKED, WITHIN = 0, 1, 2, 3      # name types; WITHIN: below a boilerplate name
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Bound of a unary log-odds on pages with marks, which say more than a single
# block's text does, and on pages without.
CLIP = {True: 1.0, False: 2.5}
NEUTRAL_NOISE = 0.02                             # least chance that a nameless block differs from its parent
# Pseudo-counts (content, boilerplate) by type and parent label: what names
# mean where no labelled page says.
PRIOR = {NEUTRAL: ((1, 3), (9, 1)), BOILERPLATE: ((1, 99), (1, 99)), MARKED: ((9, 1), (9, 1)), WITHIN: ((1, 99), (9, 1))}
ROOT_LOG = 60.0                                  # the root is no content

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""",
    re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSES_P = BLOCK - {"button", "label"}
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}}


class Page:
    """Block tree of a page: per node its parent, tag, name type and own text
    runs; ``runs`` lists (node, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.kind = [-1], ["#root"], [NEUTRAL]
        self.chars, self.linked = [0], [0]
        self.marked = [False]                  # inside an article or main
        self.runs: list[tuple[int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]      # open elements: tag, node
        text: list[str] = []
        links, at = 0, 0

        def flush() -> None:
            run = " ".join(entities.unescape("".join(text)).split()) if text else ""
            text.clear()
            if run:
                self.runs.append((stack[-1][1], run))
                self.chars[stack[-1][1]] += len(run)

        def close(to: int) -> None:
            nonlocal links
            flush()
            for tag, _ in stack[to:]:
                links -= tag == "a"
            del stack[to:]

        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                piece = source[at:m.start()]
                text.append(piece)
                if links:
                    self.linked[stack[-1][1]] += len(piece)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if stack[k][1] != stack[k - 1][1] or name in BLOCK:
                            close(k)
                        else:
                            # Closing an inline element moves no text.
                            links -= name == "a"
                            del stack[k]
                        break
                    if stack[k][0] in BLOCK and name not in BLOCK:
                        break
                continue
            if name in DROPPED:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            type_, marked = self._type(name, m[3] or "", stack[-1][1])
            if name in BLOCK or type_ == BOILERPLATE:
                if name in _CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            close(k)
                            break
                        if stack[k][0] in BLOCK:
                            break
                ends, scope = _SELF_CLOSING.get(name, ()), _SCOPE.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in scope or not ends:
                        break
                flush()
                self.parent.append(stack[-1][1])
                self.tag.append(name)
                self.kind.append(type_)
                self.chars.append(0)
                self.linked.append(0)
                self.marked.append(marked)
                stack.append((name, len(self.parent) - 1))
            else:
                stack.append((name, stack[-1][1]))
                links += name == "a"
        if at < len(source):
            text.append(source[at:])
        flush()

    def _type(self, name: str, attributes: str, parent: int) -> tuple[int, bool]:
        words, inside = {name}, self.marked[parent]
        if attributes and not (inside and name in HEADINGS):
            for m in _NAMES.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if not inside:
                    words.update(_WORD.findall(value))
                elif m[1].lower() != "id":
                    words.update(value.split())
        if inside:
            words.discard("header")            # an article's own heading
        marked = inside or name in ("article", "main")
        if words & BOILER and name not in ("html", "body", "main", "article"):
            return BOILERPLATE, marked
        if self.kind[parent] in (BOILERPLATE, WITHIN):
            return WITHIN, marked
        return (MARKED if words & CONTENT and name not in ("html", "body") else NEUTRAL), marked

    def has_marks(self) -> bool:
        return MARKED in self.kind

    def features(self) -> list[int]:
        """Bit mask of every node's features."""
        out = []
        for tag, n, linked in zip(self.tag, self.chars, self.linked):
            length = 0 if not n else 1 if n <= 20 else 2 if n <= 80 else 3 if n <= 200 else 4
            link = 0 if not linked else 1 if 2 * linked <= n else 2
            out.append(1 << KINDS.get(tag, 7) | 1 << (N_KINDS + length) | 1 << (N_KINDS + N_LENGTHS + link)
                       | 1 << (N_FEATURES - 1))
        return out

    def labels(self) -> list[bool] | None:
        """Content labels where the page marks its article, else None."""
        if not any(t in ("article", "main") for t in self.tag):
            return None
        out: list[bool] = []
        for k, (parent, tag, type_) in enumerate(zip(self.parent, self.tag, self.kind)):
            out.append(type_ not in (BOILERPLATE, WITHIN) and (tag in ("article", "main") or (k > 0 and out[parent])))
        return out


def _logistic(rows: list[tuple[int, bool, int]]) -> np.ndarray:
    """Weights of an L2-regularised logistic model, balanced by label."""
    if not rows or len({label for _, label, _ in rows}) < 2:
        return np.zeros(N_FEATURES)
    x = np.array([[mask >> k & 1 for k in range(N_FEATURES)] for mask, _, _ in rows], float)
    y = np.array([label for _, label, _ in rows], float)
    n = np.array([count for _, _, count in rows], float)
    n = np.where(y > 0, n / n[y > 0].sum(), n / n[y == 0].sum())
    w = np.zeros(N_FEATURES)
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * (x.T @ (n * (p - y)) + 0.01 * w)
    return w


class TreeModel:
    """Potentials, and the marginals they give on a page."""

    def __init__(self, nodes: list[tuple[int, bool, int]], edges: dict[tuple[bool, int, bool, bool], int]):
        self._weights = _logistic(nodes)
        self._unary: dict[int, float] = {}
        # log P(label | type, parent label), for pages with and without marks.
        self.pair = {marked: np.zeros((4, 2, 2)) for marked in (False, True)}
        for marked, table in self.pair.items():
            for type_, priors in PRIOR.items():
                for parent, (a, b) in enumerate(priors):
                    yes, no = (edges.get((marked, type_, bool(parent), label), 0) for label in (True, False))
                    p = (yes + a) / (yes + no + a + b)
                    if type_ == NEUTRAL:
                        p = NEUTRAL_NOISE + (1 - 2 * NEUTRAL_NOISE) * p
                    table[type_, parent] = math.log(1 - p), math.log(p)

    def unary(self, mask: int, type_: int, marked: bool) -> float:
        """Log-odds of content by the node's own text.  What a block that is
        named boilerplate says for itself does not count, only against it."""
        z = self._unary.get(mask)
        if z is None:
            z = self._unary[mask] = float(sum(w for k, w in enumerate(self._weights) if mask >> k & 1))
        z = max(-CLIP[marked], min(CLIP[marked], z))
        return min(z, 0.0) if type_ in (BOILERPLATE, WITHIN) else z

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by sum-product up and down the tree."""
        n, parent, kind, marked = len(page.parent), page.parent, page.kind, page.has_marks()
        pair = self.pair[marked].tolist()
        up = [[0.0, self.unary(mask, t, marked)] for mask, t in zip(page.features(), kind)]      # node and subtree
        up[0][1] -= ROOT_LOG
        sent = [None] * n
        for k in range(n - 1, 0, -1):
            (b, c), table = up[k], pair[kind[k]]
            message = [_add(table[q][0] + b, table[q][1] + c) for q in (0, 1)]
            sent[k] = message
            above = up[parent[k]]
            above[0] += message[0]
            above[1] += message[1]
        belief = [up[0]] + [None] * (n - 1)
        out = [0.0] * n
        for k in range(1, n):
            above, message, table = belief[parent[k]], sent[k], pair[kind[k]]
            rest = (above[0] - message[0], above[1] - message[1])        # the parent without this branch
            down = [_add(rest[0] + table[0][y], rest[1] + table[1][y]) for y in (0, 1)]
            total = [up[k][0] + down[0], up[k][1] + down[1]]
            top = max(total)
            belief[k] = [total[0] - top, total[1] - top]
            out[k] = 1 / (1 + math.exp(min(700.0, total[0] - total[1])))
        return out

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        p = self.marginals(page)
        return "\n".join(run for node, run in page.runs if p[node] > 0.5)


def _add(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log1p(math.exp(-abs(x - y)))


def learn(pages: DataFrame) -> TreeModel:
    """The model from about LABELLED_PAGES pages that mark their article."""
    share = min(1.0, LABELLED_PAGES / max(pages.count(), 1))
    chosen = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            seen: Counter = Counter()
            for source in part.column("html").to_pylist():
                page = Page(source or "")
                labels = page.labels()
                if labels is None:
                    continue
                for k, (mask, label) in enumerate(zip(page.features(), labels)):
                    if k:
                        type_, above = page.kind[k], labels[page.parent[k]]
                        seen[(0, mask, label)] += 1
                        seen[(1, 8 + type_ * 2 + above, label)] += 1
                        seen[(1, (NEUTRAL if type_ == MARKED else type_) * 2 + above, label)] += 1
            rows = [(a, b, c, n) for (a, b, c), n in seen.items()]
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["table", "key", "label", "n"])
    counts = chosen.select("html").mapInArrow(run, "table int, key long, label boolean, n long") \
        .groupBy("table", "key", "label").agg(F.sum("n").alias("n")).collect()   # of bounded size
    nodes = sorted((r.key, r.label, r.n) for r in counts if r.table == 0)
    edges = {(r.key >= 8, r.key % 8 // 2, bool(r.key % 2), r.label): r.n for r in counts if r.table == 1}
    return TreeModel(nodes, edges)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url and text of every row.

    Null or empty html gives empty text.  Unclosed, stray and unknown tags
    are tolerated; nothing is cut at any length.  Repeated rows get equal
    results; a null page_id or url stays null, and other columns are not
    read.  Very long pages are parsed whole.  Without labelled pages the
    priors of the name types decide, and pages without marks give nothing.
    """
    model = learn(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            text = [model.text(source) for source in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(text, pa.string())],
                names=["page_id", "url", "text"])
    types = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")) \
        .mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
