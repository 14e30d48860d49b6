"""Main text of HTML pages by line-block distribution."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

LINES = 3  # lines in a sliding window
SURGE = 60  # characters in a window where text begins
_ATTRIBUTES = r"""((?:"[^"]*"|'[^']*'|[^'">])*)"""
_NO_TEXT = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(script|style|title|textarea|noscript|template|iframe)\b{_ATTRIBUTES}>", re.S | re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "title", "textarea", "noscript", "template", "iframe")}
_TAG = re.compile(rf"<(/?)([a-zA-Z][\w:-]*){_ATTRIBUTES}>")
_SPACE = re.compile(r"[\s ]+")
_HINT = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
# fixed values: words of class names and ids that mark what is not the article, and those that may
# stand beside them in one name
_NOISE = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
_BESIDE = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "cell", "center", "col", "column", "container", "content", "entry", "first", "fixed", "global", "group", "header", "horizontal", "inner", "item", "items", "large", "last", "left", "link", "links", "list", "main",
    "mobile", "module", "outer", "page", "panel", "policy", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "story", "text", "thread", "toggle", "top", "unit", "user", "vertical", "wrap", "wrapper", "zone",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert", "form", "toolbar"}
_SKIP = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "option", "optgroup", "select", "legend", "fieldset", "datalist"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_IN_HEAD = {"meta", "link", "base", "head"}
_RESUMES = {"address", "article", "aside", "blockquote", "body", "div", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "p", "pre", "section", "table"}  # where an element that is never closed ends


def _without_raw(page: str) -> str:
    """The page without comments and without elements whose content is no text. One that closes itself
    has no content; one that is never closed has what comes before the next block."""
    out, at, open_ended = [], 0, set()
    while (found := _NO_TEXT.search(page, at)) is not None:
        out.append(page[at : found.start()])
        at, name = found.end(), (found[1] or "").lower()
        if not name or found[2].endswith("/"):
            continue
        close = None if name in open_ended else _CLOSE[name].search(page, at)
        if close:
            at = close.end()
        else:
            open_ended.add(name)
            at = next((t.start() for t in _TAG.finditer(page, at) if t[2].lower() in _RESUMES), len(page) if name in ("script", "style") else at)
    out.append(page[at:])
    return "".join(out)


def _noise(attributes: str, article: bool) -> bool:
    """Whether a class name, id, role or label says menu, advert, comments or the like: as a whole, or
    joined with words of place and kind only, so that has-sidebar says nothing of the sort."""
    for found in _HINT.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        if found[1].lower() == "role":
            if _ROLES & set(value.lower().split()):
                return True
            continue
        for name in value.split():
            parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if p]
            bad = [p for p in parts if p in _NOISE and not (article and p in ("header", "byline"))]
            if bad and all(p in _NOISE or p in _BESIDE for p in parts):
                return True
    return False


def _extents(tags: list[re.Match]) -> tuple[list[int], list[bool]]:
    """For each start tag the number of the tag that ends it (its own end tag, or that of an element
    round it), and whether it is its own."""
    ends, closed, stack, open_ = [len(tags)] * len(tags), [False] * len(tags), [], {}
    for i, tag in enumerate(tags):
        name = tag[2].lower()
        if not tag[1]:
            if name not in _VOID and not tag[3].endswith("/"):
                stack.append((name, i))
                open_[name] = open_.get(name, 0) + 1
        elif open_.get(name):
            while True:
                other, j = stack.pop()
                open_[other] -= 1
                ends[j] = i
                if other == name:
                    closed[j] = True
                    break
    return ends, closed


def lines_of(page: str) -> tuple[list[str], list[int], list[int]]:
    """Lines of a page without markup, one a block: text, its characters outside links, and whether
    it stands in an article (2), in the main part (1) or in neither (0). Blocks inside menus, headers,
    forms and the like are left out."""
    page = _without_raw(page)
    tags = list(_TAG.finditer(page))
    ends, closed = _extents(tags)
    names = [t[2].lower() for t in tags]
    # characters outside links ahead of each tag
    plain, links, end = np.zeros(len(tags) + 2, np.int64), 0, 0
    for i, tag in enumerate(tags):
        plain[i + 1] = 0 if links else len(page[end : tag.start()].strip())
        end = tag.end()
        if names[i] == "a":
            links = max(0, links + (-1 if tag[1] else 1))
        elif names[i] in _BLOCK:
            links = 0
    plain[-1] = len(page[end:].strip())
    before = np.cumsum(plain)  # up to each tag, and up to the end
    held = lambda i, j: int(before[j] - before[i])
    total = int(before[-1])

    def skipped(i: int, article: bool) -> int:
        """The number of the tag up to which the element of start tag i is left out, or -1."""
        name = names[i]
        if name == "head":
            stop = next((j for j in range(i + 1, ends[i]) if names[j] not in _IN_HEAD), ends[i])
            return min(stop, ends[i])
        by_tag = name in _SKIP and not (name == "header" and article)
        if not by_tag and (name in ("body", "html", "main", "article") or not _noise(tags[i][3], article)):
            return -1
        if not closed[i]:
            return next((j for j in range(i + 1, ends[i]) if not tags[j][1] and names[j] in _RESUMES), ends[i])
        # a form round the whole page, or a name that does not mean what it says
        if (name == "form" or not by_tag) and held(i, ends[i]) * 5 > total * 4:
            return -1
        return ends[i]

    texts, own, inside = [], [], []
    parts, count, links, upto, end, where = [], 0, 0, -1, 0, [0, 0]

    def flush() -> None:
        nonlocal parts, count
        line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if line:
            texts.append(line)
            own.append(count)
            inside.append(2 if where[0] else 1 if where[1] else 0)
        parts, count = [], 0

    for i, tag in enumerate(tags):
        if i > upto and tag.start() > end:  # what stands before the tag where a skipped element ends goes too
            parts.append(page[end : tag.start()])
            count += 0 if links else len(page[end : tag.start()].strip())
        end = tag.end()
        if i < upto:
            continue
        closing, name = bool(tag[1]), names[i]
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in _BLOCK:
            flush()
            links = 0
        if name in ("article", "main") and (closing or closed[i] or ends[i] == len(tags)):
            k = int(name == "main")
            where[k] = max(0, where[k] + (-1 if closing else 1))
        elif not closing and name not in _VOID and not tag[3].endswith("/"):
            stop = skipped(i, where[0] > 0)
            if stop > i:
                flush()
                upto = stop
    if upto < len(tags):
        parts.append(page[end:])
        count += len(page[end:].strip())
    flush()
    return texts, own, inside


def main_text(page: str) -> str:
    """Text between surge and dive points of the line-block distribution.

    A window's height is the characters, outside links, of LINES following lines. Text begins where
    the height passes SURGE (or half the page's greatest height, if that is less) and ends where it
    falls under half of that, or where a line of copyright begins. In a page that marks its article,
    or else its main part, and has most of its characters there, the points are sought among its
    lines, any text there is a surge and only a height of 0 is a dive.
    """
    texts, own, inside = lines_of(page)
    lengths, where = np.array(own, np.int64), np.array(inside, np.int64)
    marked = False
    for level in (2, 1):
        if (among := where >= level).any() and lengths[among].sum() * 2 >= lengths.sum() > 0 and lengths[among].any():
            texts, lengths, marked = [t for t, a in zip(texts, among, strict=True) if a], lengths[among], True
            break
    if not len(lengths) or not lengths.any():
        return ""
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(len(lengths))
    height = total[np.minimum(at + LINES, len(lengths))] - total[at]
    surge = 0 if marked else min(SURGE, int(height.max()) // 2)
    keep, begun = [], False
    for k, h in enumerate(height):
        if not begun and h > surge and lengths[k]:
            begun = True
        elif begun and (h == 0 or h * 2 < surge or (not marked and _RIGHTS.match(texts[k]))):
            begun = False
        if begun:
            keep.append(texts[k])
    return "\n\n".join(keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), a row per input row.

    A null or empty page, or one without main text, gives an empty text. Null ids and urls and rows
    that repeat come back as they are; an empty table gives no rows. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
