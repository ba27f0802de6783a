"""Main text of web pages from flat blocks and a small decision tree.

A page becomes a flat list of text blocks. Each block is described by its own
and its neighbours' word count and link density, by the kind of element that holds it
and by whether it stands among the page's running text. A decision tree, grown here on the
small table of labelled blocks below, keeps the blocks of the article.

Names of classes are read one by one: a name such as ``with-sidebar`` or ``has-nav`` tells of the
layout, not of the content, and where one name speaks for the article and another against it the
text decides. A form that holds most of a page's running text is its frame, and no form of that page.

Defined cases: null, empty and text-free pages give an empty text; broken or unclosed
markup is read as far as it goes; repeated rows are pages of their own; an empty
table gives no rows; other columns are ignored; no block is dropped for its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text at all.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea", "option", "button"}
# Their content is not markup: it ends at its own end tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "acronym",
}
# Elements around the article. 1: never article, 2: article, 3: form.
HOLDERS = {"nav": 1, "header": 1, "footer": 1, "aside": 1, "form": 3, "dialog": 1, "menu": 1, "article": 2, "main": 2}
HINT = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|newsletter|subscri\w*|sidebar|side|widget|related|"
    r"recommend\w*|share|sharing|social|comment\w*|reply|replies|discussion|disqus|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|header|masthead|"
    r"footer|copyright|legal|login|signup|search|toolbar|tags?)(?:$|[-_ ])", re.I,
)
# Names that tell what a page has or what a text is about, not what the element is.
LAYOUT = re.compile(r"(?:has|with|without|no|is|tag|tagged|category|format|layout)[-_]", re.I)
GOOD_HINT = re.compile(r"(?:^|[-_ ])(?:article|content|post|entry|story|main|body|text)(?:$|[-_ ])", re.I)
ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 1, "search": 1, "dialog": 1, "form": 1, "main": 2, "article": 2}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


UNKNOWN, NEVER, ARTICLE, FORM = range(4)


def named_kind(names: str, kind: int) -> int:
    """The kind of an element of that kind by its tag, once its class or id is read."""
    words = [name for name in names.split() if not LAYOUT.match(name)]
    bad = [bool(HINT.search(name)) for name in words]
    good = any(GOOD_HINT.search(name) and not against for name, against in zip(words, bad))
    if any(bad):
        return kind if good else NEVER
    return ARTICLE if good and kind == UNKNOWN else kind


def holder_kind(tag: str, attributes: str) -> int:
    """UNKNOWN, NEVER article, ARTICLE, or FORM: not article unless it frames the page."""
    kind = HOLDERS.get(tag, UNKNOWN)
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return NEVER
            if name == "role":
                kind = ROLES.get(value.lower(), kind)
            elif name in ("class", "id") and tag not in ("body", "html"):
                kind = named_kind(value, kind)
    return kind


def running(words: int, linked: int) -> bool:
    """Whether a block is running text."""
    return words >= 20 and linked < 0.3 * words


def framed(found: list[tuple[str, int, int, int, bool]]) -> list[tuple[str, int, int, int, bool]]:
    """The blocks with their forms decided: UNKNOWN where forms hold more running text than the rest of the page."""
    inside = sum(b[1] for b in found if b[3] == FORM and running(b[1], b[2]))
    outside = sum(b[1] for b in found if b[3] in (UNKNOWN, ARTICLE) and running(b[1], b[2]))
    kind = UNKNOWN if inside > outside else NEVER
    return [(text, words, linked, kind if holder == FORM else holder, heading) for text, words, linked, holder, heading in found]


def blocks(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words, linked words, holder, heading) of every block, in order."""
    out: list[tuple[str, int, int, int, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []  # open holders
    silent: list[str] = []
    in_link, heading, at, size = 0, 0, 0, len(page)

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            words = len(text.split(" "))
            links = len(html.unescape(" ".join(linked)).split())
            kinds = [k for _, k in stack if k]
            kind = UNKNOWN
            for k in kinds:  # nothing inside a menu, an advert or an unseen element is article
                if kind != NEVER and not (kind == ARTICLE and k == FORM):
                    kind = k
                elif kind == ARTICLE:
                    kind = NEVER  # a form within an article
            out.append((text, words, min(links, words), kind, bool(heading)))
        parts.clear()
        linked.clear()

    while at < size:
        match = TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at and not silent:
            text = page[at:stop]
            parts.append(text)
            if in_link:
                linked.append(text)
        if not match:
            break
        at = match.end()
        end, start, attributes = match.group(1), match.group(2), match.group(3)
        if start:
            tag = start.lower()
            alone = tag in VOID or attributes.endswith("/") and tag in ("svg", "math")
            if tag in RAW or tag in SILENT:
                if tag not in INLINE:
                    close()
                if tag in RAW:
                    over = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                    at = over.end() if over else size
                elif not alone:
                    silent.append(tag)
                continue
            if silent:
                if tag == "body":  # an unclosed head
                    silent.clear()
                else:
                    continue
            if tag == "a":
                in_link += 1
            if tag in INLINE:
                continue
            if tag == "br" and "".join(parts).strip() and parts[-1] != "\n":  # a second one in a row ends the block
                parts.append("\n")
                continue
            close()
            if tag in VOID:
                continue
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading += 1
            kind = holder_kind(tag, attributes)
            if tag == "header" and any(k == ARTICLE for _, k in stack):  # the head of an article
                kind = UNKNOWN
            stack.append((tag, kind))
        elif end:
            tag = end.lower()
            if silent:
                if tag in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(tag) :]
                continue
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                continue
            close()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = max(0, heading - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
    close()
    return framed(out)


FEATURES = ["holder_no", "holder_yes", "words", "density", "before_words", "before_density", "after_words", "after_density", "heading", "inside"]


def features(found: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """One row per block. Word counts are cut at 100, as longer blocks are alike."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    holder = np.array([b[3] for b in found])
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = holder == 1, holder == 2
    out[:, 2], out[:, 3] = np.minimum(words, 100), density
    out[1:, 4], out[1:, 5] = out[:-1, 2], density[:-1]
    out[:-1, 6], out[:-1, 7] = out[1:, 2], density[1:]
    out[:, 8] = [b[4] for b in found]
    # Whether running text (20 words or more, few links, no menu) stands both before and after, or is this block.
    body = (words >= 20) & (density < 0.3) & (holder != 1)
    out[:, 9] = np.logical_or.accumulate(body) & np.logical_or.accumulate(body[::-1])[::-1]
    return out


# Labelled blocks: the features in the order of FEATURES, then 1 for article text.
LABELLED = [
    # in nav, header, footer, aside, forms, adverts, comments
    (1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (1, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (1, 0, 9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0),
    (1, 0, 25, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0), (1, 0, 60, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0), (1, 0, 12, 0.2, 100, 0.0, 0, 0.0, 0, 0, 0),
    (1, 0, 4, 0.0, 3, 0.0, 30, 0.0, 1, 0, 0), (1, 0, 100, 0.0, 5, 0.0, 100, 0.0, 0, 0, 0), (1, 0, 6, 0.5, 90, 0.1, 6, 0.5, 0, 1, 0),
    (1, 0, 35, 0.1, 2, 0.0, 3, 0.0, 0, 1, 0), (1, 0, 3, 0.0, 50, 0.0, 50, 0.0, 1, 1, 0), (1, 0, 1, 0.0, 100, 0.0, 100, 0.0, 0, 1, 0),
    # in an article holder
    (0, 1, 8, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1), (0, 1, 1, 0.0, 40, 0.0, 70, 0.0, 0, 1, 1), (0, 1, 1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1),
    (0, 1, 100, 0.0, 8, 0.0, 100, 0.0, 0, 1, 1), (0, 1, 45, 0.1, 100, 0.0, 20, 0.0, 0, 1, 1), (0, 1, 12, 0.4, 60, 0.0, 60, 0.1, 0, 1, 1),
    (0, 1, 3, 0.0, 100, 0.0, 10, 0.0, 0, 0, 1), (0, 1, 30, 0.0, 3, 0.0, 9, 0.0, 0, 1, 1), (0, 1, 6, 0.0, 6, 0.0, 6, 0.0, 1, 0, 1),
    (0, 1, 2, 0.0, 1, 1.0, 80, 0.0, 1, 0, 1), (0, 1, 5, 1.0, 30, 0.0, 30, 0.0, 0, 1, 1), (0, 1, 14, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    # an article holder with menus of links in it
    (0, 1, 3, 1.0, 3, 1.0, 4, 1.0, 0, 1, 0), (0, 1, 4, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (0, 1, 2, 1.0, 5, 1.0, 3, 1.0, 0, 0, 0),
    # no holder known
    (0, 0, 100, 0.0, 10, 0.0, 100, 0.0, 0, 1, 1), (0, 0, 40, 0.05, 100, 0.0, 30, 0.0, 0, 1, 1), (0, 0, 25, 0.0, 3, 0.0, 60, 0.0, 0, 1, 1),
    (0, 0, 5, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1), (0, 0, 1, 0.0, 30, 0.0, 100, 0.0, 0, 1, 1), (0, 0, 7, 0.0, 100, 0.0, 70, 0.0, 1, 1, 1),
    (0, 0, 40, 0.0, 30, 0.0, 3, 0.0, 0, 1, 1), (0, 0, 60, 0.0, 4, 0.0, 1, 0.0, 0, 1, 1), (0, 0, 2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1),
    (0, 0, 55, 0.0, 20, 0.0, 0, 0.0, 0, 1, 1), (0, 0, 7, 0.0, 50, 0.0, 5, 0.0, 0, 1, 1), (0, 0, 30, 0.1, 6, 0.0, 2, 1.0, 0, 1, 1),
    (0, 0, 80, 0.0, 2, 0.0, 6, 0.5, 0, 1, 1), (0, 0, 4, 0.2, 8, 0.0, 6, 0.0, 0, 1, 1), (0, 0, 100, 0.0, 1, 1.0, 4, 1.0, 0, 1, 1),
    (0, 0, 20, 0.2, 50, 0.0, 50, 0.0, 0, 1, 1), (0, 0, 9, 0.0, 2, 1.0, 80, 0.0, 1, 0, 1), (0, 0, 6, 0.0, 5, 0.0, 100, 0.0, 1, 0, 1),
    (0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (0, 0, 3, 1.0, 2, 1.0, 20, 0.0, 0, 0, 0), (0, 0, 8, 0.9, 9, 0.8, 7, 1.0, 0, 1, 0),
    (0, 0, 10, 0.1, 100, 0.0, 0, 0.0, 0, 0, 0), (0, 0, 4, 0.0, 3, 0.5, 2, 1.0, 0, 0, 0), (0, 0, 15, 0.6, 30, 0.0, 8, 1.0, 0, 0, 0),
    (0, 0, 12, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (0, 0, 2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (0, 0, 3, 0.0, 8, 1.0, 6, 1.0, 1, 0, 0),
    (0, 0, 5, 1.0, 60, 0.0, 5, 1.0, 0, 1, 0), (0, 0, 4, 1.0, 5, 1.0, 40, 0.0, 0, 1, 0), (0, 0, 18, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0),
]
MAX_DEPTH = 6


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 0) -> tuple:
    """A tree of (feature, bound, low side, high side) or a label, by Gini impurity."""
    ones = int(labels.sum())
    if ones in (0, len(labels)) or depth == MAX_DEPTH:
        return (int(2 * ones > len(labels)),)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < bound
            score = sum(len(part) - ((part == 1).sum() ** 2 + (part == 0).sum() ** 2) / len(part) for part in (labels[low], labels[~low]))
            if best is None or score < best[0] - 1e-12:
                best = score, f, bound
    if best is None:
        return (int(2 * ones > len(labels)),)
    _, f, bound = best
    low = rows[:, f] < bound
    return f, float(bound), grow(rows[low], labels[low], depth + 1), grow(rows[~low], labels[~low], depth + 1)


@lru_cache(maxsize=1)
def trained() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1].astype(int))


def verdicts(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), bool(tree[0]))
    f, bound, low, high = tree
    side = rows[:, f] < bound
    out = np.empty(len(rows), bool)
    out[side], out[~side] = verdicts(low, rows[side]), verdicts(high, rows[~side])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = verdicts(trained(), features(found))
    return "\n".join(block[0] for block, keep in zip(found, kept) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
