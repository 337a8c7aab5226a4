"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element.  What stands in a menu,
header, footer, sidebar, notice, advert, form or reader comment (by element,
role, class or identifier) keeps its line with a length of 0, and so does a run
of lines that are nothing but links.  The lengths are summed over windows of
``WINDOW`` lines.  The text starts where the sums surge and ends where they
dive to 0 again; what lies between is kept, but for the lines of length 0.
Where the page marks its article, the surge and the dive are sought within that
element and any text counts; elsewhere within the element that holds most of
the text, and if that is the whole body, a window must hold ``LEAST``
characters.

Character references are decoded, white space (Unicode) in a block becomes one
space, a line break a space, two a new block.  Unclosed elements end as in
browsers where that matters here: paragraphs, list items and cells end when the
next begins, an end tag ends all that is open above its element, comments,
scripts and styles without an end reach to the end of the page.

A null or empty page gives an empty text; so does a page of markup only.  Pages
are handled one by one and whole: a task holds a batch of pages.  Null
identifiers and addresses pass through, repeated rows each get their row,
further columns, whatever their names, are not read, an empty table gives no
rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.shared import small_batches, trimmed

#: Lines of a window, and the characters in one that make a surge where no element marks the article.
WINDOW, LEAST = 3, 86
#: Lines of links only, one after the other, that make a menu.
MENU = 3

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "a": {"a"}}
_HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}  # an open item is not looked for beyond these
_IN_TEXT = {"li", "ul", "ol", "dl", "dt", "dd", "blockquote", "figure", "figcaption", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "hgroup", "details"}
#: Elements and roles beside the article.
_ASIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "status"}
#: Words of a class or identifier that tell the same.
_HINTS = set(
    "ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav aside menu menus mainmenu submenu nav navs navbar subnav topnav navigation breadcrumb breadcrumbs masthead topbar header footer notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion widget widgets toolbar pagination pager copyright disclaimer form".split()
)
_COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "discussion", "respond"}
_NEGATED = {"has", "with", "no", "without", "is"}


class _Tree:
    """Elements by number: parent, name, the article or main element around them, and whether they stand beside the article."""

    def __init__(self):
        self.name, self.parent, self.article, self.aside = [""], [-1], [0], [0]
        self.top, self.still = 0, Counter()

    def open(self, name: str, aside: int) -> None:
        self.name.append(name)
        self.parent.append(self.top)
        self.aside.append(aside)
        self.article.append(self.article[self.top])
        at, self.top = self.top, len(self.name) - 1
        self.still[name] += 1
        if name in ("article", "main"):  # what was only guessed of the elements around it was wrong
            while at > self.article[self.top]:
                self.aside[at] = 0 if self.aside[at] == 1 else self.aside[at]
                at = self.parent[at]
            self.article[-1] = self.top

    def close(self, names: set[str], within: set[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, and what is open within it."""
        at = self.top if any(self.still[n] for n in names) else 0
        while at > 0 and self.name[at] not in names:
            at = 0 if self.name[at] in within else self.parent[at]
        while at > 0 and self.top != self.parent[at]:
            self.still[self.name[self.top]] -= 1
            self.top = self.parent[self.top]

    def beside(self) -> list[bool]:
        out = [False]
        for up, own in zip(self.parent[1:], self.aside[1:], strict=True):
            out.append(out[up] or own > 0)
        return out


def _aside(tree: _Tree, name: str, attributes: str) -> int:
    """0: may be part of the article, 1: not, by class or identifier, 2: not, by element, role or as hidden."""
    if name == "header" and tree.article[tree.top]:
        return 0
    if name in _ASIDE:
        return 2
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if given.get("role", "").lower() in _ROLES or given.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) or "display:none" in given.get("style", "").replace(" ", "").lower():
        return 2
    if name in ("html", "body", "main"):
        return 0
    allowed = {"header"} if tree.article[tree.top] else set()
    for one in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(one)]
        if words and words[0] not in _NEGATED and not (_COMMENTS if name == "article" else _HINTS - allowed).isdisjoint(words):
            return 2 if not _COMMENTS.isdisjoint(words) else 1
    return 0


def lines_of(page: str) -> tuple[_Tree, list[tuple[str, int, int]]]:
    """The elements, and (text, characters in links, element) of each line, in order."""
    tree, lines, parts, linked, breaks, links, at, muted = _Tree(), [], [], 0, 0, 0, 0, []

    def flush():
        nonlocal linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, linked, tree.top))
        parts.clear()
        linked = breaks = 0

    def add(text):
        nonlocal linked, breaks
        if text and not muted:
            text = html.unescape(text)
            parts.append(text)
            if not text.isspace():
                breaks = 0
            if links:
                linked += len(" ".join(text.split()))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        follows = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = _TAG.match(page, start)
        if not tag:
            if follows and (follows in "!?/" or follows.isascii() and follows.isalpha()):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                add("<")
                at = start + 1
            continue
        at, name, closing = tag.end(), tag[1].lower(), page[start + 1] == "/"
        if name in _RAW and not closing:
            if not tag[2].endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                end = page.find(">", end.start()) if end else -1
                at = end + 1 if end >= 0 else len(page)
        elif name == "br":
            breaks += 1
            if breaks == 2:
                flush()
            else:
                parts.append(" ")
        elif name in _BLOCKS:
            flush()
            if closing:
                tree.close({name})
            elif name not in _VOID:
                tree.close({"p"}, _HOLDS)
                if name in _CLOSED_BY_NEXT:
                    tree.close(_CLOSED_BY_NEXT[name], _HOLDS)
                tree.open(name, _aside(tree, name, tag[2]))
            muted.clear()
            links = 0
        elif muted:
            if name == muted[0]:
                muted.extend([name] * (not closing)) if not closing else muted.pop()
        elif name == "a":
            links = 0 if closing else 1
        elif not closing and name not in _VOID and not tag[2].endswith("/") and _aside(tree, name, tag[2]):
            muted.append(name)
    flush()
    return tree, lines


def _sums(lengths: list[int]) -> list[int]:
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def _region(tree: _Tree, elements: list[int], lengths: list[int], beside: list[bool]) -> tuple[int, bool]:
    """The element within which the text lies, and whether the page marks it."""
    own = [0] * len(tree.name)
    for e, n in zip(elements, lengths, strict=True):
        own[e] += n
    whole = list(own)
    for e in range(len(whole) - 1, 0, -1):
        whole[tree.parent[e]] += whole[e]
    best = {name: max((e for e, n in enumerate(tree.name) if n == name and not beside[e]), key=lambda e: (whole[e], -e), default=0) for name in ("article", "main")}
    marked = best["article"] if best["article"] and whole[best["article"]] * 2 >= whole[best["main"]] else best["main"]
    if marked and whole[marked]:
        return marked, True
    direct: dict[int, int] = {}
    for e, n in enumerate(own):
        at = e
        while tree.name[at] in _IN_TEXT:
            at = tree.parent[at]
        direct[at] = direct.get(at, 0) + n
    at = max(direct, key=lambda e: (direct[e], -e))
    while at > 0 and whole[at] * 5 < whole[tree.parent[at]] * 3:
        at = tree.parent[at]
    return at, False


def extract(page: str | None) -> str:
    """The lines of the article, joined by line feeds."""
    tree, lines = lines_of(page or "")
    if not lines:
        return ""
    beside = tree.beside()
    alone = [linked >= len(text) for text, linked, _ in lines]
    lengths, k = [0 if beside[e] else len(text) for text, _, e in lines], 0
    while k < len(lines):  # runs of links
        end = k
        while end < len(lines) and alone[end]:
            end += 1
        if end - k >= MENU:
            lengths[k:end] = [0] * (end - k)
        k = max(end, k + 1)
    region, marked = _region(tree, [e for _, _, e in lines], lengths, beside)
    within = [False] * len(tree.name)
    within[region] = True
    for e in range(region + 1, len(within)):
        within[e] = within[tree.parent[e]]
    inner = [n if within[e] else 0 for n, (_, _, e) in zip(lengths, lines, strict=True)]
    least = LEAST if not marked and tree.name[region] in ("", "html", "body") else 1
    over = [i for i, s in enumerate(_sums(inner)) if s >= least] or [i for i, s in enumerate(_sums(inner)) if s]
    if not over:
        return ""
    surge, dive = over[0], min(over[-1] + WINDOW, len(lines))
    if least > 1:  # short lines at the rim of the first and of the last window are not yet, or no longer, text
        long = [i for i in range(surge, dive) if inner[i] * WINDOW >= least] or [i for i in range(surge, dive) if inner[i]]
        surge, dive = long[0], long[-1] + 1
    if not marked:
        while surge and lengths[surge - 1] and tree.name[lines[surge - 1][2]] in ("h1", "h2"):
            surge -= 1
            inner[surge] = lengths[surge]
    return "\n".join(lines[i][0] for i in range(surge, dive) if inner[i])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of each page."""

    @trimmed
    def run(batches):
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    narrow = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
