"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|itemprop)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is not markup or never shown.
RAW = {"script", "style", "template", "iframe", "title", "textarea", "desc", "metadata", "annotation", "annotation-xml", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start of one of these ends the open one of its group, within the nearest of the second set.
ENDS = {
    **dict.fromkeys(("li",), ({"li"}, {"ul", "ol", "menu", "dir"})), **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})), **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}),
}
NOT_IN_P = BLOCKS - {"button", "option", "legend", "caption", "select", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that are never shown as text of a page, and those that rarely hold a part of an article.
UNSHOWN = {"head", "select", "button"}
OUTSIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form", "toolbar", "tablist"}
BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|sidebar|side|related|"
    r"recommend\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|reply|replies|respond|disqus|discussion|widget|toolbar|pagination|pager|login|signin|signup|copyright|legal|hidden|skip|search|"
    r"outbrain|taboola|paywall|survey|feedback)(?:$|[\s_-])", re.I,
)
#: Names of what an element has, is filed under or allows, which say nothing of what it is.
STATE = re.compile(r"(?<!\S)(?:(?:has|with|no|without|category|tag)[-_]\S+|\S+[-_](?:open|closed|enabled|disabled))(?!\S)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])", re.I)

#: What the classifier reads of a block, whole, with nothing of the markup that labels are taken from: 1, the logarithm of its
#: length, the share of linked characters, and per word stops, commas, digits, capitals and signs of rights; whether
#: it is a paragraph, a heading, an item of a list or a cell.
TRAITS = ("one", "length", "links", "stops", "commas", "digits", "capitals", "rights", "paragraph", "heading", "item", "cell")
DIGIT, CAPITAL = re.compile("[0-9]"), re.compile("[A-ZÀ-ÖØ-Þ]")
#: Log odds by trait where no page names its main element.
STATED = (-2.0, 0.7, -5.0, 3.0, 2.0, -1.0, -0.5, -6.0, 2.0, 1.6, -0.5, -0.5)
#: Bounds of the sample that the weights are fitted on: pages with a main element, and blocks of one, spread evenly; ridge penalty.
SAMPLE_PAGES, SAMPLE_BLOCKS, RIDGE = 2000, 200, 1.0
#: The classifier's log odds count up to this; what the markup says is added to them.
MOST = 3.0
NEVER, OUT, FLAGGED, IN_ARTICLE, NO_ARTICLE, GOOD_NAME = 1000.0, -10.0, -10.0, 4.0, -4.0, 1.0
#: Of the edge between neighbours on the page, and of that between neighbours in one element.
ADJACENT, SIBLING = 0.5, 0.7


class Block:
    __slots__ = ("text", "tag", "parent", "hidden", "hard", "flagged", "article", "good", "linked", "flags")


def blocks_of(source: str) -> list[Block]:
    """Text blocks in page order, with what their open elements say of them."""
    out: list[Block] = []
    # tag, number of the element, 1 outside an article or 2 hidden, numbers of flagged elements, in article, good names, in a link
    stack = [("", 0, 0, (), False, False, False)]
    held: set[int] = set()  # flagged elements that are or hold the main element
    outer: set[int] = set()  # flagged elements that are an article or in none
    parts: list[tuple[str, bool]] = []
    number = at = 0

    def flush():
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                b = Block()
                k = next((e for e in reversed(stack) if e[0] in BLOCKS), stack[0])
                b.text, b.tag, b.linked = text, k[0], sum(len(t) for t, linked in parts if linked)
                _, _, level, b.flags, b.article, b.good, _ = stack[-1]
                b.hard, b.hidden = level > 0, level > 1
                # Paragraphs and the like hang together by the element around them.
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] == k[1]), 0)
                b.parent = stack[max(0, i - 1)][1] if k[0] not in ("div", "section", "article", "main", "body") else k[1]
                out.append(b)
            parts = []

    def close(i):
        if any(e[0] in BLOCKS or e[3] != stack[-1][3] for e in stack[i:]) or (i and (stack[i - 1][3] != stack[-1][3] or stack[i - 1][2] != stack[-1][2])):
            flush()
        del stack[i:]

    def add(text):
        if text:
            parts.append((html.unescape(text) if "&" in text else text, stack[-1][6]))

    while m := TAG.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                parts.append((" ", False))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        if name in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in VOID:
            if name == "br":
                parts.append((" ", False))
            elif name == "hr":
                flush()
            continue
        if name in NOT_IN_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in ENDS:
            ended, within = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ended:
                    close(i)
                    break
                if stack[i][0] in within:
                    break
        _, _, hard, flagged, article, good, linked = stack[-1]
        bad, named = 2 if name in UNSHOWN else int(name in OUTSIDE), name == "noscript" and not article
        if m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or "").strip("\"'").strip()
                if key in ("class", "id"):
                    if name not in ("html", "body"):
                        own = CAMEL.sub(" ", STATE.sub(" ", value))
                        value = CAMEL.sub(" ", value)
                        named = named or bool(BAD.search(own)) or (not article and bool(HEADER.search(own)))
                        good = good or bool(GOOD.search(value))
                elif key == "role":
                    bad = max(bad, int(value.lower() in ROLES))
                    article = article or value.lower() in ("article", "main")
                elif key == "style":
                    bad = 2 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else bad
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    bad = 2
                elif key == "itemprop":
                    good = good or value.lower() == "articlebody"
        if name == "header" and not article:
            bad = max(bad, 1)
        number += 1
        if named:
            flagged = (*flagged, number)
            if not article or name in ("article", "main"):
                outer.add(number)
        if name == "main":
            held.update(flagged)
        article = article or name in ("article", "main")
        if name in BLOCKS or flagged != stack[-1][3] or bad > hard:
            flush()
        stack.append((name, number, max(hard, bad), flagged, article, good, linked or name == "a"))
    add(source[at:])
    flush()
    # A flag does not count on what holds half of the page's prose.
    prose: dict[int, int] = {}
    for b in out:
        for k in () if b.hard else b.flags:
            prose[k] = prose.get(k, 0) + len(b.text) - b.linked
    half = sum(len(b.text) - b.linked for b in out if not b.hard) / 2
    held.update(k for k, n in prose.items() if k in outer and n >= half)
    for b in out:
        b.flagged = any(k not in held for k in b.flags)
    return out


def traits(b: Block) -> list[float]:
    text, n = b.text, b.text.count(" ") + 1
    marks = text.count("\N{COPYRIGHT SIGN}") + text.lower().count("all rights reserved")
    count = lambda signs: sum(map(text.count, signs)) / n
    return [
        1.0, math.log1p(len(text)), min(1.0, b.linked / len(text)), count(".!?"), count(",;:"), len(DIGIT.findall(text)) / n, len(CAPITAL.findall(text)) / n, min(1.0, 12 * marks / n),
        float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "dd", "dt")), float(b.tag in ("td", "th", "caption")),
    ]


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge penalty on all but the first, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(pages: DataFrame) -> tuple[float, ...]:
    """Weights of TRAITS from blocks inside and outside the main elements of a sample of pages.

    The sample is drawn by a hash of the html, equal pages being one, and bounded by SAMPLE_PAGES pages (in expectation)
    and SAMPLE_BLOCKS blocks of each. STATED where fewer than 20 blocks of either kind are found.
    """

    def run(batches):
        for b in batches:
            found = []
            for source in b["html"].to_pylist():
                blocks = [x for x in blocks_of(source) if not x.hidden]
                if any(x.article for x in blocks):
                    for k in np.unique(np.linspace(0, len(blocks) - 1, min(len(blocks), SAMPLE_BLOCKS)).astype(int)):
                        x = blocks[k]
                        found.append([*traits(x), float(x.article and not x.hard and not x.flagged)])
            yield pa.RecordBatch.from_pydict({"rows": pa.array([np.array(found, np.float64).tobytes()], pa.binary())})

    known = pages.select("html").filter("html IS NOT NULL")
    share = min(1.0, SAMPLE_PAGES / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))).distinct()
    rows = [np.frombuffer(r["rows"]).reshape(-1, len(TRAITS) + 1) for r in drawn.mapInArrow(run, "rows binary").toLocalIterator()]
    data = np.concatenate([np.zeros((0, len(TRAITS) + 1)), *rows])
    inside = data[:, -1].sum()
    return tuple(fitted(data[:, :-1], data[:, -1]).tolist()) if 20 <= inside <= len(data) - 20 else STATED


def odds(b: Block, has_article: bool, weights: tuple[float, ...] = STATED) -> float:
    """Log odds that a block is content: the classifier's, bounded, and what the markup says."""
    if b.hidden:
        return -NEVER
    out = max(-MOST, min(MOST, sum(w * t for w, t in zip(weights, traits(b)))))
    out += OUT * b.hard + FLAGGED * b.flagged + GOOD_NAME * b.good
    return out + (IN_ARTICLE * b.article if b.article or not has_article else NO_ARTICLE)


def minimum_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that maximise the gains of those set less the weights of the edges between different labels.

    A node whose gain outweighs its edges keeps its sign in some optimum, so it is fixed and its edges
    become gains of its neighbours; what is left is cut by augmenting shortest paths.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    gain, label = list(gain), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                gain[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        s, t = n, n + 1
        flow: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
        for i in left:
            flow[s][i], flow[i][s] = max(gain[i], 0.0), 0.0
            flow[i][t], flow[t][i] = max(-gain[i], 0.0), 0.0
        while True:
            before, queue = {s: s}, deque([s])
            while queue and t not in before:
                x = queue.popleft()
                for y, room in flow[x].items():
                    if room > 1e-9 and y not in before:
                        before[y] = x
                        queue.append(y)
            if t not in before:
                break
            path, y = [], t
            while y != s:
                path.append((before[y], y))
                y = before[y]
            room = min(flow[x][y] for x, y in path)
            for x, y in path:
                flow[x][y] -= room
                flow[y][x] += room
        for i in left:
            label[i] = i in before
    return label


def main_text(source: str, weights: tuple[float, ...] = STATED) -> str:
    found = blocks_of(source)
    has_article = any(b.article and not b.hard and not b.flagged for b in found)
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = ADJACENT
        if b.parent in last:
            key = (last[b.parent], i)
            edges[key] = edges.get(key, 0.0) + SIBLING
        last[b.parent] = i
    label = minimum_cut([odds(b, has_article, weights) for b in found], edges)
    return " ".join(b.text for b, content in zip(found, label) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a row of pages.

    A classifier of blocks is fitted on a bounded sample of pages that name their main element. Blocks of text are the nodes of a graph: the classifier's costs of either label are its terminal
    capacities, and blocks next to each other on the page or in one element are joined by smoothness
    edges; the side of the minimum cut with the content is the text. Null or empty html, and pages
    without content, have an empty text; pages are read whole; repeated rows are each extracted; an empty
    table gives no rows.
    """

    weights = learn(pages)

    def run(batches):
        for b in batches:
            text = [main_text(x or "", weights) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b["page_id"], "url": b["url"], "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
