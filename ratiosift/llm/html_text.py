"""Main text of web pages by gradient-boosted trees over page nodes (operator 10).

A tolerant reader turns a page into block-level nodes and the runs of text directly inside them. Trees score each node
from what its subtree holds (text, links, punctuation, text for each node), its tag and the words of its class and id, the
same of its ancestors, depth, place among its siblings, and its neighbours. Decoding works on the whole tree: a node is
all main text, all other text, or mixed, and only the parts of a mixed node are judged on their own; the likeliest
consistent assignment is found bottom-up. So nothing inside a dropped part is kept and nothing inside a kept one dropped.

The trees are fitted in numpy, once for each process, on ``html_layouts`` (``PAGES`` made-up pages of known main text).
Scripts, styles, heads and controls of forms are never text. Character references are decoded, white space in a block
becomes one space, and blocks are joined by an empty line. Null and empty pages give an empty text. Pages of any length
are read whole.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_layouts
from .textkernel import tidy

PAGES, TREES, DEPTH, RATE, BINS = 700, 70, 5, 0.2, 32
_CHUNK_CHARS = 1 << 20

#: Fixed values of HTML: elements that start a block, never have content, are not text, or end an open paragraph or item.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea template iframe select button head".split())
_CLOSES_P = _BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
_SAME = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",))}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?,;:]")

_GROUPS = {
    "nav": "nav navbar navigation menu topnav sitenav navlinks breadcrumb breadcrumbs pagination pager toolbar",
    "header": "header masthead topbar banner",
    "footer": "footer bottom colophon copyright legal",
    "side": "sidebar side aside rail widget widgets complementary col",
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promoted adsense",
    "comment": "comment comments commentlist discussion responses response disqus replies reply respond reader",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay banner disclaimer warning",
    "more": "related share sharing social recommended recommendations more tags popular trending",
    "form": "form login search subscribe signup newsletter contact register",
    "main": "article content post entry story main body text maintext articlebody",
}
_BITS = {word: 1 << k for k, words in enumerate(_GROUPS.values()) for word in words.split()}
_TAG_BITS = {"nav": 1, "menu": 1, "header": 2, "footer": 4, "aside": 8, "form": 256, "article": 512, "main": 512, "dialog": 64}
_BITS["banner"] |= _BITS["header"] | _BITS["ad"]
_N_GROUPS = len(_GROUPS)
_KINDS = {t: k for k, ts in enumerate(("p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu dir", "div", "article main", "section", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tfoot tr", "td th", "blockquote pre figure figcaption", "body html")) for t in ts.split()}
_N_KINDS = 18


def parse(page: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, str, int]], list[int]]:
    """Nodes in page order as (parent, kind, own bits, inputs), runs as (node, text, characters in links), and for each
    node the number of the node after its subtree."""
    nodes, runs, ends = [(-1, _KINDS["body"], 0, 0)], [], [0]
    stack, at = ["body"], [0]  # open block elements and their nodes
    text, linked, link, pos = [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                runs.append((at[-1], own, min(linked, len(own))))
            text.clear()
        linked = 0

    def pop(n: int) -> None:
        while len(stack) > n:
            stack.pop()
            ends[at.pop()] = len(nodes)

    for m in _TOKEN.finditer(page):
        start, end = m.span()
        if start < pos:
            continue
        if start > pos:
            text.append(page[pos:start])
            if link:
                linked += start - pos
        pos = end
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag in _BLOCKS:
                flush()
                if tag in stack[1:]:
                    pop(len(stack) - 1 - stack[::-1].index(tag))
                link = 0
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, end)
            pos = close.end() if close else (len(page) if tag != "head" else end)
            text.append(" ")
            if tag in ("textarea", "select", "button") and nodes:
                p, k, b, n = nodes[at[-1]]
                nodes[at[-1]] = (p, k, b, n + 1)
        elif tag in _BLOCKS:
            flush()
            link = 0
            if tag in ("html", "body") or tag == "hr":
                continue
            if tag in _CLOSES_P and "p" in stack:
                k = len(stack) - 1 - stack[::-1].index("p")
                if not any(x in ("td", "th", "table") for x in stack[k:]):
                    pop(k)
            if tag in _SAME:
                same, until = _SAME[tag]
                k = len(stack) - 1
                lowest = None
                while k > 0 and stack[k] not in until:
                    if stack[k] in same.split():
                        lowest = k
                    k -= 1
                if lowest is not None:
                    pop(lowest)
            bits = _TAG_BITS.get(tag, 0)
            if m[3]:
                for a in _ATTRIBUTE.finditer(m[3]):
                    for word in _WORD.findall((a[1] or a[2] or a[3] or "").lower()):
                        bits |= _BITS.get(word, 0)
            nodes.append((at[-1], _KINDS.get(tag, _N_KINDS - 1), bits, 0))
            ends.append(0)
            stack.append(tag)
            at.append(len(nodes) - 1)
        elif tag == "a":
            link = 1
        elif tag == "br":
            text.append(" ")
        elif tag == "input":
            p, k, b, n = nodes[at[-1]]
            nodes[at[-1]] = (p, k, b, n + 1)
    if pos < len(page):
        text.append(page[pos:])
    flush()
    pop(0)
    return nodes, runs, ends


def features(parsed: list) -> np.ndarray:
    """A row for each node of these pages."""
    base = np.cumsum([0] + [len(p[0]) for p in parsed])
    n = int(base[-1])
    nodes = np.array([x for p in parsed for x in p[0]], np.int64).reshape(-1, 4)
    page = np.repeat(np.arange(len(parsed)), np.diff(base))
    first = base[page]
    end = np.array([e for p in parsed for e in p[2]], np.int64) + first
    root = nodes[:, 0] < 0
    parent = np.where(root, np.arange(n), nodes[:, 0] + first)
    own = np.zeros((n, 7))  # characters, in links, words, stops, runs, paragraphs, inputs
    for k, (_, runs, _) in enumerate(parsed):
        for node, text, linked in runs:
            own[base[k] + node, :5] += (len(text), linked, text.count(" ") + 1, len(_STOP.findall(text)), 1)
    own[:, 5] = nodes[:, 1] == _KINDS["p"]
    own[:, 6] = nodes[:, 3]
    total = np.vstack((np.zeros(7), np.cumsum(own, axis=0)))
    sub = total[end] - total[np.arange(n)]
    depth, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order, count, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    up = parent.tolist()
    bits = nodes[:, 2].tolist()
    depth_, above_, order_, count_, last_, before_, after_ = ([0] * n, [0] * n, [0] * n, [0] * n, [-1] * n, [-1] * n, [-1] * n)
    for i in range(n):
        p = up[i]
        if p != i:
            depth_[i], above_[i] = depth_[p] + 1, above_[p] | bits[p]
            order_[i] = count_[p]
            count_[p] += 1
            if (b := last_[p]) >= 0:
                before_[i], after_[b] = b, i
            last_[p] = i
    depth, above, order, count, before, after = map(np.array, (depth_, above_, order_, count_, before_, after_))
    whole = np.maximum(sub[first], 1)
    chars, links, words, stops, runs = (sub[:, k] for k in range(5))
    density = lambda i: np.where(i >= 0, links[i] / np.maximum(chars[i], 1), -1)
    length = lambda i: np.where(i >= 0, np.log1p(chars[i]), -1)
    columns = [(nodes[:, 1] == k) for k in range(_N_KINDS)]
    columns += [nodes[:, 2] >> k & 1 for k in range(_N_GROUPS)] + [above >> k & 1 for k in range(_N_GROUPS)]
    columns += [depth, order, count[parent], order / np.maximum(count[parent], 1), (np.arange(n) - first) / np.maximum(end[first] - first, 1), (total[np.arange(n), 0] - total[first, 0]) / whole[:, 0]]
    columns += [np.log1p(chars), np.log1p(own[:, 0]), links / np.maximum(chars, 1), np.log1p(words), stops / np.maximum(words, 1), words / np.maximum(runs, 1), stops / np.maximum(runs, 1)]
    columns += [chars / whole[:, 0], stops / whole[:, 3], sub[:, 5], sub[:, 5] / np.maximum(whole[:, 5], 1), sub[:, 6], np.log1p(chars / np.maximum(end - np.arange(n), 1)), end - np.arange(n)]
    columns += [length(parent), density(parent), chars / np.maximum(chars[parent], 1), length(before), density(before), length(after), density(after), count, nodes[parent, 1] == _KINDS["article"], stops[parent] / np.maximum(words[parent], 1)]
    return np.column_stack(columns).astype(np.float32)


class Trees:
    """Boosted regression trees of one depth for two classes, fitted on binned features with second-order steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        width = BINS
        flat = binned + np.arange(x.shape[1]) * width
        score = np.zeros(len(y))
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                m, size = 2**level, x.shape[1] * width
                key = (node[:, None] * size + flat).ravel()
                sums = [np.bincount(key, np.repeat(v, x.shape[1]), m * size).reshape(m, x.shape[1], width).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (ga, ha) = sums, [s[:, :1, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1)
                gain[(hl < 1) | (ha - hl < 1)] = 0
                best = gain.reshape(m, -1).argmax(axis=1)
                f, b = best // width, best % width
                better = gain.reshape(m, -1)[np.arange(m), best] > (ga**2 / (ha + 1)).ravel() + 1e-6
                at = m - 1 + np.arange(m)
                feature[at] = f
                cut[at] = [cuts[i][j] if ok and j < len(cuts[i]) else np.inf for i, j, ok in zip(f, b, better, strict=True)]
                node = 2 * node + (x[np.arange(len(y)), f[node]] > cut[at][node])
            leaf = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            score += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut.astype(np.float32))
            self.leaf.append(leaf)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


@functools.cache
def train(pages: int = PAGES) -> Trees:
    parsed, label, weight = [], [], []
    for page in html_layouts.pages(pages):
        nodes, runs, ends = parse(page)
        good, all_ = np.zeros(len(nodes) + 1), np.zeros(len(nodes) + 1)
        for node, text, _ in runs:
            all_[node + 1] += len(text)
            good[node + 1] += len(text) * (text[0] == html_layouts.MARK)
        good, all_ = np.cumsum(good), np.cumsum(all_)
        share = [(good[e] - good[i]) / max(1, all_[e] - all_[i]) for i, e in enumerate(ends)]
        parsed.append((nodes, [(n, t.replace(html_layouts.MARK, ""), k) for n, t, k in runs], ends))
        label += [float(s > 0.5) for s in share]
        weight += [float(all_[e] > all_[i]) for i, e in enumerate(ends)]
    return Trees(features(parsed), np.array(label), np.array(weight))


#: What a node costs, in log-likelihood, that is neither all main text nor none.
_MIXED = -1.5


def decode(score: list[float], parents: list[int], holds: list[bool]) -> list[bool]:
    """The likeliest consistent choice for each node: whether text directly inside it is main text."""
    n = len(score)
    inside, outside, mixed = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if holds[i]:
            s = score[i]
            inside[i] -= np.log1p(np.exp(-s)) if s > -30 else -s
            outside[i] -= np.log1p(np.exp(s)) if s < 30 else s
        mixed[i] += _MIXED
        if (p := parents[i]) >= 0:
            inside[p] += inside[i]
            outside[p] += outside[i]
            mixed[p] += max(inside[i], outside[i], mixed[i])
    state, keep = [""] * n, [False] * n
    for i in range(n):
        p = parents[i]
        if p >= 0 and state[p] != "mixed":
            state[i] = state[p]
        else:
            best = max(inside[i], outside[i], mixed[i])
            state[i] = "in" if best == inside[i] else "out" if best == outside[i] else "mixed"
        keep[i] = state[i] == "in" or state[i] == "mixed" and score[i] > 0
    return keep


def main_text(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    scores = trees.scores(features(parsed)).tolist()
    out, base = [], 0
    for nodes, runs, ends in parsed:
        holding = np.zeros(len(nodes) + 1, np.int64)
        for node, _, _ in runs:
            holding[node + 1] += 1
        seen = np.cumsum(holding).tolist()
        keep = decode(scores[base : base + len(nodes)], [x[0] for x in nodes], [seen[e] > seen[i] for i, e in enumerate(ends)])
        out.append("\n\n".join(text for node, text, _ in runs if keep[node]))
        base += len(nodes)
    return out


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``. Other columns than ``page_id``, ``url`` and ``html``
    are ignored; any of the three may be null, and repeated rows stay."""
    given = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lo = batch.column(2), 0
            while lo < len(column):
                chunk, size, hi = [], 0, lo
                while hi < len(column) and (size < _CHUNK_CHARS or hi == lo):
                    chunk.append(column[hi].as_py() or "")
                    size += len(chunk[-1])
                    hi += 1
                text = main_text(chunk, given.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                lo = hi

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
