"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and of runs of words. Words score positive: as often as
words in such a place are content. Tags score negative: a little, and more the rarer
such tags are content. One linear scan finds the contiguous region with the highest
sum, whose words are the result, but for those in places that are less often content
than not (an aside within the article).

All scores are learned from labelled pages, those that mark their content with
``<article>``; at most ``train_pages`` of them, with the smallest hashes of their ids,
are counted. The mark itself scores nothing, so a page is treated alike with and without it.
A place is the innermost element (with its classes, id and role) and the nearest
element around it that has such names or is a section; places that were never seen
score as their elements do, and elements that were never seen by ``PRIOR``.

Defined results: a null or empty page, or one without words, gives an empty text;
repeated rows give repeated results; unclosed and truncated elements end with
their parent; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import words

TRAIN_PAGES = 2000
#: What each tag costs, what it costs more by its share outside of content, and how many observations a prior counts for.
TAG_COST, OUTSIDE_COST, PRIOR_WEIGHT = 0.1, 2.0, 5.0
MARK = "article"

# Fixed values of HTML: elements whose content isn't shown as text, those that a head may hold (any other one ends it), elements that don't break a line, elements without
# an end, sections, and sections and controls that are beside the content of what they stand in.
UNSHOWN = {"head", "iframe", "noscript", "script", "style", "svg", "template", "title"}
HEAD_PARTS = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "img", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BESIDE = {"aside", "button", "dialog", "footer", "form", "menu", "nav", "select", "textarea"}
SECTIONS = BESIDE | {"header", "main", "section"}
PROSE = {"blockquote", "dd", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "main", "ol", "p", "pre", "table", "tbody", "td", "th", "thead", "tr"}
#: Share of content of elements that no labelled page has; a form may hold a whole page.
PRIOR = dict.fromkeys(BESIDE - {"form"}, 0.05) | dict.fromkeys(INLINE | VOID | PROSE, 0.9)
PRIOR_ELSE = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: What stands for a tag that doesn't end; groups as in ``_TOKEN``.
_NO_TAG = re.compile(r"()()()()</[^>]*(?:>|\Z)|(<)")


class Ends:
    """Which tags of a page end, when some don't: each quote and each ``>`` outside of quotes is looked at once for all that fail."""

    def __init__(self, page: str):
        self.names = [m.start() for m in re.finditer(r"[\s/>]", page)]
        self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        self.signs = [page[x] for x in self.marks]
        self.size = len(page)
        self.closing, last = [-1] * len(self.marks), {}
        for k in range(len(self.marks) - 1, -1, -1):
            self.closing[k] = last.get(self.signs[k], -1)
            last[self.signs[k]] = k
        self.lost: set[int] = set()

    def fails(self, at: int) -> bool:
        """Whether the attributes of the tag that begins at ``at`` run into a quote that isn't closed."""
        end = bisect_left(self.names, at + 2)
        k, path = bisect_left(self.marks, self.names[end] if end < len(self.names) else self.size), []
        while k < len(self.marks) and self.signs[k] != ">" and k not in self.lost:
            path.append(k)
            if self.closing[k] < 0:
                break
            k = self.closing[k] + 1
        else:
            if k >= len(self.marks) or self.signs[k] == ">":
                return False
        self.lost.update(path)
        return True


def _found(page: str) -> Iterator[re.Match]:
    """The tokens of a page, in time in proportion to its length also where tags don't end."""
    at, ends = 0, None
    while at < len(page):
        tag = page[at] == "<" and page[at + 1 : at + 3].lstrip("/")[:1].isalpha() and page[at + 1 : at + 3].isascii()
        if tag and ends and ends.fails(at):
            m = _NO_TAG.match(page, at)
        else:
            m = _TOKEN.match(page, at)
            if tag and not ends and (m.end() == at + 1 or m[3] is None and m[1] is None and page[at + 1] == "/"):
                ends = Ends(page)
        yield m
        at = m.end()


#: Kind (``<`` or ``w``), label of the (innermost) element, label of the nearest marked one around it.
Feature = tuple[str, str, str]


def tokens(page: str) -> Iterator[tuple[Feature, str, bool]]:
    """Feature, text (of a run of words or of white space), and whether it breaks the line; unshown text is none."""
    # label, name, nearest marked label around what stands in the element, whether its text is shown
    stack: list[tuple[str, str, str, bool]] = [("", "", "", True)]
    held: Counter = Counter()  # by name, so that an end tag without a start is known at once
    for m in _found(page):
        label, _, around, shown = stack[-1]
        if m[5] is not None:
            if shown:
                yield ("w", label, around), m[5], False
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            label = name
            if held[name]:
                while True:
                    own, closed, _, _ = stack.pop()
                    held[closed] -= 1
                    if closed == name:
                        break
                label, around = own or name, stack[-1][2]
            yield ("<", "/" + (MARK if name == MARK else label), around), "", name not in INLINE
            continue
        if stack[-1][1] == "head" and name not in HEAD_PARTS:
            held[stack.pop()[1]] -= 1
            label, _, around, shown = stack[-1]
        names = " ".join(x.strip("\"'") for x in _NAMES.findall(m[4])) if m[4] else ""
        own = f"{name}.{names}" if names else name
        yield ("<", MARK if name == MARK else own, around), "", name not in INLINE
        if name == MARK:
            held[name] += 1
            stack.append((label, name, around, shown))
        elif name not in VOID:
            held[name] += 1
            stack.append((own, name, own if names or name in SECTIONS else around, shown and name not in UNSHOWN))


def count(page: str) -> Counter:
    """How often each feature of a labelled page stands in its content, and how often elsewhere.

    The content is what the article holds but not what is beside it there: in an aside, a form and
    the like, or in an article of its own, which by the standard is a reader's comment. The tags of
    such parts count as inside: content goes on behind them.
    """
    seen: Counter = Counter()
    inside, beside, held = 0, [], Counter()
    for feature, text, _ in tokens(page):
        kind, label, _around = feature
        name = label.lstrip("/").split(".")[0]
        if kind == "<" and name == MARK:
            inside = max(0, inside + (-1 if label[0] == "/" else 1))
            beside, held = [], Counter()
            continue
        if kind == "<" and inside and name in BESIDE and label[0] != "/":
            beside.append(name)
            held[name] += 1
        if kind == "<" or not text.isspace():
            seen[feature, inside > 0 if kind == "<" else inside == 1 and not beside] += len(text.split()) if kind == "w" else 1
        if kind == "<" and label[0] == "/" and held[name]:
            while held[name]:  # to the first of that name
                held[beside.pop()] -= 1
    return seen


class Shares:
    """Shares of content by feature, from counts; the more is counted, the less the wider place or the prior matters."""

    def __init__(self, counts: dict[tuple[Feature, bool], int] | None = None):
        self.exact, self.label, self.around = ({False: Counter(), True: Counter()} for _ in range(3))
        for ((kind, label, around), inside), n in (counts or {}).items():
            self.exact[inside][kind, label, around] += n
            self.label[inside][kind, label] += n
            self.around[inside][kind, around] += n
        self.known: dict[Feature, float] = {}

    @staticmethod
    def _share(found: dict[bool, Counter], key: tuple, prior: float) -> float:
        yes, no = found[True][key], found[False][key]
        return (yes + PRIOR_WEIGHT * prior) / (yes + no + PRIOR_WEIGHT)

    def share(self, feature: Feature) -> float:
        if feature not in self.known:
            kind, label, around = feature
            own, outer = (x.lstrip("/").split(".")[0] for x in (label, around))
            wide = self._share(self.label, (kind, label), PRIOR.get(own, PRIOR_ELSE))
            held = self._share(self.around, (kind, around), PRIOR[outer] if outer in BESIDE and outer in PRIOR else 1.0) if around else 1.0
            self.known[feature] = self._share(self.exact, feature, min(wide, held))
        return self.known[feature]

    def score(self, feature: Feature) -> float:
        """Of a word (positive) or a tag (negative; the mark of labelled pages: nothing)."""
        if feature[0] == "w":
            return self.share(feature)
        return 0.0 if feature[1].lstrip("/") == MARK else -TAG_COST - OUTSIDE_COST * (1 - self.share(feature))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous region with the highest sum: the first one to end, and the shortest of these; (0, 0) if none is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        total += score
        if total <= 0:
            total, begin = 0.0, at + 1
        elif total > best:
            best, span = total, (begin, at + 1)
    return span


def main_text(page: str, shares: Shares) -> str:
    """The text of the region with the highest score."""
    found = list(tokens(page))
    span = best_region([shares.score(f) * (len(text.split()) if f[0] == "w" else 1) for f, text, _ in found])
    parts = []
    for feature, text, breaks in found[slice(*span)]:
        if feature[0] == "w":
            if shares.share(feature) >= 0.5:
                parts.append(html.unescape(text))
        elif breaks:
            parts.append("\n")
    return " ".join("".join(parts).split())


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, key: str = "page_id") -> Shares:
    """Shares from at most ``train_pages`` labelled pages; what reaches the driver is two numbers for each of their features."""
    labelled = pages.where(F.col("html").rlike(f"(?is)<{MARK}\\b.*</{MARK}")).select(F.xxhash64(key).alias("h"), "html")
    edge = labelled.select("h").orderBy("h").limit(train_pages).agg(F.max("h")).first()[0]
    if edge is None:
        return Shares()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for page in frame["html"]:
                seen.update(count(page))
        yield pd.DataFrame([(*feature, inside, n) for (feature, inside), n in seen.items()], columns=["kind", "label", "around", "inside", "n"])

    counted = labelled.where(F.col("h") <= edge).select("html").mapInPandas(words.returning(work), "kind string, label string, around string, inside boolean, n long")
    summed = counted.groupBy("kind", "label", "around", "inside").agg(F.sum("n").alias("n")).collect()
    return Shares({((r["kind"], r["label"], r["around"]), r["inside"]): r["n"] for r in summed})


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text`` of every page; see the module for the method and the defined results."""
    shares = train(pages, train_pages)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "html"):
                text = [main_text(x or "", shares) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(words.returning(work), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
