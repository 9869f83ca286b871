"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A classifier gives each block a cost for calling it
content and one for calling it boilerplate; these are the capacities of its edges to the two
terminals. Neighbouring blocks, and blocks of one kind that follow each other under one element,
are joined by smoothness edges that grow with what they have in common in the page's tree; a heading is
tied to the block that follows it. The minimum cut, found by maximum flow, is the labelling of least cost.

The classifier adds the evidence of a block's elements, their class and id words, and a logistic
model over the block's words and links. The model is trained on blocks of ``TRAIN_PAGES`` pages at
most, the first by hash of the page; pages with semantic elements give the labels.

A null or empty page has empty text; broken markup is read as far as it goes; equal rows give
equal texts; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profitloom.llm.common import batches, record_batch, ship

_BYTES = 8 << 20
#: Pages, and blocks of each, from which the classifier is trained.
TRAIN_PAGES = 400
TRAIN_BLOCKS = 64
#: Most that the model adds to a block's evidence; blocks with less evidence than that train nothing.
MODEL_BOUND = 2.0

#: Elements that begin and end a block of text; fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page; fixed values.
RAW_TAGS = frozenset("script style template textarea iframe svg object canvas audio video".split())
#: Elements that hold boilerplate, and those that hold the article; fixed values.
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog head title fieldset option legend search".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Words of classes and ids; fixed values.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu sidebar side footer header masthead topbar comment comments reply replies disqus cookie cookies consent gdpr "
    "notice notification alert newsletter subscribe subscription signup login share sharing social related "
    "recommended breadcrumb breadcrumbs popup modal overlay widget form search toolbar copyright legal disclaimer "
    "pagination pager tags tagcloud skip hidden".split()
)
CONTENT_WORDS = frozenset("article content main post entry story text body".split())
VOID_TAGS = frozenset("hr".split())
_CLOSED_BY_SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")


#: The model is for running text and adds this to a heading at most; the edge to the next block under
#: the heading's element is stronger, so that without other evidence the block decides for both.
HEADING_BOUND, HEADING = 0.5, 1.0
#: Evidence of a boilerplate element, and of elements that hold the article or are named for it.
BOILER, ARTICLE, NAMED = -8.0, 5.0, 3.0


class Element:
    """An element of the page: the number of the one above, whether it belongs to the page's frame,
    whether only its name speaks for boilerplate, its evidence for content, and whether it is or
    lies in an element with such evidence."""

    __slots__ = ("above", "tag", "frame", "named", "lift", "inside")

    def __init__(self, above: int, tag: str, attributes: str):
        self.above, self.tag = above, tag
        # A form may hold the whole page.
        self.frame, self.named = tag in BOILER_TAGS and tag != "form", tag == "form"
        self.lift = ARTICLE if tag in CONTENT_TAGS else 0.0
        if not attributes or self.frame:
            return
        self.frame = bool(_HIDDEN.search(attributes))
        words = {w for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
        if self.named:
            return
        if words & CONTENT_WORDS:
            self.lift = max(self.lift, NAMED)
        elif words & BOILER_WORDS and tag not in CONTENT_TAGS and tag not in ("body", "html"):
            self.named = True
        if words & BOILER_WORDS and tag in CONTENT_TAGS:
            self.tag = ""  # a comment, say: not the page's article


class Block:
    """A run of text: the numbers of its element and of the one above, how deep it lies, how many of its
    elements hold the block before it too, the elements' evidence, their tag and its link letters."""

    __slots__ = ("text", "at", "above", "depth", "shared", "score", "tag", "linked")

    def __init__(self, text, at, above, depth, shared, tag, linked):
        self.text, self.at, self.above, self.depth, self.shared = text, at, above, depth, shared
        self.score, self.tag, self.linked = 0.0, tag, linked


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, in time and memory linear in its length, however deep it is."""
    out: list[Block] = []
    elements = [Element(0, "", "")]
    elements[0].inside = False
    stack: list[tuple[str, int]] = [("", 0)]  # element and its number
    places: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
    shared = 1  # how much of the stack is as it was at the last block
    links, position, end = 0, 0, len(page)
    parts: list[str] = []
    linked = 0

    def cut_to(size):
        nonlocal shared
        while len(stack) > size:
            places[stack.pop()[0]].pop()
        shared = min(shared, size)

    def close_block():
        nonlocal linked, shared
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                tag, at = stack[-1]
                out.append(Block(text, at, elements[at].above, len(stack), shared, tag, min(linked, len(text))))
                shared = len(stack)
            parts.clear()
        linked = 0

    while position < end:
        found = _TOKEN.search(page, position)
        start = found.start() if found else end
        if start > position:
            text = page[position:start]
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        position = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        closing = found[1] == "/"
        # What is for readers without scripts counts within content only.
        if name in RAW_TAGS or name == "noscript" and not elements[stack[-1][1]].inside:
            if not closing and not found[0].endswith("/>"):
                shut = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, position)
                position = shut.end() if shut else end
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCK_TAGS:
            continue
        close_block()
        links = 0
        if closing:
            if places.get(name):
                cut_to(places[name][-1])
            continue
        if stack[-1][0] == "p":
            cut_to(len(stack) - 1)
        if name in _CLOSED_BY_SAME and places.get(name):
            stops = [places[t][-1] for t in _CLOSED_BY_SAME[name] if places.get(t)]
            if places[name][-1] > max(stops, default=0):
                cut_to(places[name][-1])
        if name in VOID_TAGS:
            continue
        above = stack[-1][1]
        elements.append(Element(above, name, found[3].rstrip(">")))
        elements[-1].inside = elements[above].inside or elements[-1].lift > 0
        places.setdefault(name, []).append(len(stack))
        stack.append((name, len(elements) - 1))
    close_block()
    weigh(out, elements)
    return out


def weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Give each block the evidence of its elements, from the root down.

    The page's frame (nav, footer, hidden elements and so on) stays boilerplate all the way down.
    Names and forms may as well be a wrapper's: of their evidence only the part reaches the elements
    below that corresponds to the text they leave out, of the page's articles (else of its main
    element, else of its text without the frame), and content below adds its own evidence again.
    """
    n = len(elements)
    framed = [False] * n
    kinds = [e.tag if e.tag in CONTENT_TAGS else "" for e in elements]
    for i, e in enumerate(elements[1:], 1):
        framed[i] = framed[e.above] or e.frame or e.tag == "header" and not elements[e.above].inside
        if kinds[e.above] == "article" or not kinds[i]:
            kinds[i] = kinds[e.above]
    texts = {kind: [0] * n for kind in ("article", "main", "")}
    for b in blocks:
        if not framed[b.at]:
            texts[kinds[b.at]][b.at] += len(b.text)
    for text in texts.values():
        for i in range(n - 1, 0, -1):
            text[elements[i].above] += text[i]
    text = texts["article"]
    if not text[0]:
        text = texts["main"] if texts["main"][0] else texts[""]
    # Evidence for text that stands right in the element, and for the elements below it.
    own, below = [0.0] * n, [0.0] * n
    for i, e in enumerate(elements[1:], 1):
        above = below[e.above]
        if framed[i]:
            own[i] = below[i] = BOILER
        elif e.named:
            share = text[i] / max(text[0], 1)
            own[i], below[i] = BOILER, share * above + (1 - share) * BOILER
        else:
            own[i] = below[i] = above + e.lift if above < 0 else max(above, e.lift)
    for b in blocks:
        b.score = own[b.at]


FEATURES = 5


def features(block: Block) -> list[float]:
    """What the logistic model sees of a block: its words, links and signs, nothing of the page's layout."""
    text = block.text
    words = text.count(" ") + 1
    return [
        1.0,
        log(words),
        block.linked / len(text),
        1.0 if text[-1] in ".!?:;\"'”»" else 0.0,
        min(text.count(",") / words, 1.0),
    ]


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge; zeros if there is only one label."""
    weights = np.zeros(FEATURES)
    if len(set(labels.tolist())) < 2:
        return weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + ridge * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each of n nodes, whether a minimum cut leaves it on the source's side.

    Dinic's method: breadth-first levels, then blocking flows along them.
    """
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        if source[i] > 0:
            link(s, i, source[i], 0.0)
        if sink[i] > 0:
            link(i, t, sink[i], 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for a in queue:
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = s
        while True:
            if at == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            else:
                if at == s:
                    break
                e = path.pop()
                at = to[e ^ 1]
                turn[at] += 1
                continue
            path.append(e)
            at = to[e]


def label(blocks: list[Block], weights: np.ndarray, smooth: float = 1.5) -> list[bool]:
    """Which blocks are content.

    Neighbours of one kind under one element pull each other with ``smooth``, and so do blocks that only
    other elements part; a heading and the block after it under its element with ``HEADING``; other
    neighbours with a fifth of ``smooth``, by the share of the tree above them that they have in common.
    """
    n = len(blocks)
    w = weights.tolist()
    scores = []
    for b in blocks:
        bound = HEADING_BOUND if b.tag in HEADING_TAGS else MODEL_BOUND
        scores.append(b.score + max(-bound, min(bound, sum(x * y for x, y in zip(features(b), w)))))
    edges, last_under = [], {}
    for i, b in enumerate(blocks):
        under = (b.above, b.tag)
        before = last_under.get(under)
        if before is not None:
            edges.append((before, i, smooth))
        if i and before != i - 1:
            a = blocks[i - 1]
            title = a.tag in HEADING_TAGS and b.tag not in HEADING_TAGS and a.above == b.above
            edges.append((i - 1, i, HEADING if title else 0.2 * smooth * b.shared / max(a.depth, b.depth)))
        last_under[under] = i
    return max_flow_side(n, [max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], edges)


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, content in zip(blocks, label(blocks, weights)) if content)


def fit(pages: DataFrame, column: str = "html") -> np.ndarray:
    """The logistic model's weights, from a bounded sample of the pages."""
    ship(pages.sparkSession)
    some = pages.select(F.col(column).alias("_html")).where("_html is not null")
    some = some.orderBy(F.xxhash64("_html"), F.octet_length("_html")).limit(TRAIN_PAGES)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64())])
        for batch in batches(source, _BYTES):
            x, y = [], []
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page)
                if not any(b.score > 0 for b in blocks):
                    continue
                step = max(1, -(-len(blocks) // TRAIN_BLOCKS))
                for i in range(0, len(blocks), step):
                    if abs(blocks[i].score) > MODEL_BOUND:
                        x.append(features(blocks[i]))
                        y.append(float(blocks[i].score > 0))
            if x:
                yield record_batch(schema, [x, y])

    rows = some.mapInArrow(run, "x array<double>, y double").orderBy("x", "y").collect()
    return train(np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["y"] for r in rows]))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The ``keep`` columns of each page with its main text and the text's code points."""
    weights = fit(pages, column)
    frame = pages.select(*keep, F.col(column).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BYTES):
            kept = batch.columns[:-1]
            texts = [main_text(page or "", weights) for page in batch.column(batch.num_columns - 1).to_pylist()]
            schema = pa.schema([*list(batch.schema)[:-1], ("text", pa.string()), ("n_chars", pa.int64())])
            yield record_batch(schema, [*kept, texts, [len(t) for t in texts]])

    return frame.mapInArrow(run, f"{fields}, text string, n_chars long")
