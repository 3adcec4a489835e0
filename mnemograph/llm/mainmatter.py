"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped to lines, one a block of text; leaving or entering a container is an empty
line. A line weighs its text outside links. Sums over sliding windows of ``WINDOW`` lines surge where the main
text begins and dive where ``WINDOW`` lines in a row weigh nothing. The text from surge to dive is kept.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: A window surges from this many characters on, and from this share of the page's heaviest window.
SURGE, SHARE = 80, 0.15
#: Bytes of text in one batch that leaves a task.
BATCH = 8 << 20

_RAW = "script|style|noscript|template|textarea|select|iframe|object|svg|canvas|title|head(?=[\\s>])"
#: Elements that are no part of a page's text, whatever holds them.
_DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "map", "audio", "video"}
_ROLES = {"navigation", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "banner"}
#: Parts of class names and ids that tell menus, notices, adverts, side columns and readers' comments.
_PARTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "lightbox",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "sidebar", "aside", "footer",
    "comment", "comments", "disqus", "respond", "replies", "discussion", "related", "recommended", "recommendations", "share", "sharing", "social",
    "newsletter", "subscribe", "subscription", "signup", "login", "masthead", "skip",
}
#: First parts of names that only say what a page or box has beside it.
_STATES = {"has", "no", "with", "without", "is", "js", "hide"}
_CONTAINERS = {
    "article", "body", "div", "main", "section", "header", "table", "ul", "ol", "dl", "html", "center", "figure", "blockquote", "details", "tbody", "thead", "tfoot",
} | _DROPPED
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "pre", "hr", "address", "caption", "figcaption", "summary", "legend", "hgroup"} | _CONTAINERS
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_SPACED = {"br", "td", "th", "wbr", "option"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|(?=<body[\s>])|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _named(names: str) -> set[str]:
    found = set()
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if parts and parts[0] not in _STATES:
            found.update(parts)
    return found


def _aside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds no main text."""
    if tag in _DROPPED:
        return True
    if tag in ("html", "body", "main") or tag not in _CONTAINERS | {"p", "span", "li", "ins", "a"}:
        return False
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    parts = _named(attributes.get("class", "")) | _named(attributes.get("id", ""))
    if parts & _PARTS:
        return True
    return not in_article and (tag == "header" or (tag != "article" and "header" in parts))


def _tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, value, attributes): text, or the name of an opened, closed or raw element."""
    found, at = [], 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            found.append(("text", html[at : m.start()], ""))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            found.append(("text", m[0][9:-3].replace("&", "&amp;"), ""))
        elif m[3]:
            found.append(("close" if m[2] else "open", m[3].lower(), m[4]))
    if at < len(html):
        found.append(("text", html[at:], ""))
    return found


def _ends(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """Index of the closing tag of each element that is closed."""
    open_at: dict[str, list[int]] = {}
    found = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in _VOID:
            open_at.setdefault(name, []).append(i)
        elif kind == "close" and open_at.get(name):
            found[open_at[name].pop()] = i
    return found


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, within an article) of each line; ("", 0, ..) are empty lines.

    What isn't main text by its element, role or name is left out. Such an element that
    is never closed ends at the next block. Outside an article it leaves a gap of empty lines.
    """
    tokens = _tokens(html)
    ends = _ends(tokens)
    lines: list[tuple[str, int, bool]] = []
    pieces: list[str] = []
    free, links, depth, i = 0, 0, 0, 0

    def flush(empty: int) -> None:
        nonlocal free
        text = " ".join("".join(pieces).split())
        if text:
            lines.append((text, free, depth > 0))
        pieces.clear()
        free = 0
        lines.extend([("", 0, depth > 0)] * empty)

    while i < len(tokens):
        kind, name, attributes = tokens[i]
        if kind == "text":
            text = unescape(name)
            pieces.append(text)
            free += 0 if links else sum(map(len, text.split()))
        elif kind == "open":
            if name not in _VOID and _aside(name, _attributes(attributes), depth > 0):
                if name in _BLOCKS:
                    flush(0 if depth else WINDOW)
                end = ends.get(i)
                if end is None:
                    end = i
                    while end + 1 < len(tokens) and (tokens[end + 1][0] == "text" or tokens[end + 1][1] not in _BLOCKS):
                        end += 1
                i = end + 1
                continue
            if name in ("article", "main"):
                flush(WINDOW)
                depth += 1
            elif name in _BLOCKS:
                flush(int(name in _CONTAINERS and not depth))
            links += name == "a"
        else:
            if name in ("article", "main"):
                flush(0)
                depth = max(0, depth - 1)
                flush(WINDOW)
            elif name in _BLOCKS:
                flush(int(name in _CONTAINERS and not depth))
            if name == "a":
                links = max(0, links - 1)
        if kind != "text" and name in _SPACED:
            pieces.append(" ")
        i += 1
    flush(0)
    return lines


def main_lines(lines: list[tuple[str, int, bool]]) -> list[str]:
    """The lines between surges and dives.

    Where there is an article its lines weigh enough to surge and nothing else has weight. Lines without an
    empty one between them are a group, and a group surges if the sum of a window in it does. ``WINDOW`` lines in a row
    without weight are a dive. Surging groups are kept, and what lies between two of them without a dive.
    If nothing reaches ``SURGE``, the heaviest group surges.
    """
    if any(inside for text, _, inside in lines if text):
        weights = [max(weight, SURGE) if inside and text else 0 for text, weight, inside in lines]
        share = 0.0
    else:
        weights, share = [weight for _, weight, _ in lines], SHARE
    sums, start = [0] * len(lines), 0
    for i, (text, _, _) in enumerate([*lines, ("", 0, False)]):
        if text:
            continue
        if i > start:
            sums[start:i] = [max(sum(weights[j : min(j + WINDOW, i)]) for j in range(start, i))] * (i - start)
        start = i + 1
    heaviest = max(sums, default=0)
    least = min(max(SURGE, share * heaviest), heaviest)
    kept: list[str] = []
    waiting: list[str] = []
    nothing, surged = 0, False
    for (text, _, _), weight, most in zip(lines, weights, sums, strict=True):
        surges = bool(text) and 0 < least <= most
        nothing = 0 if weight or surges else nothing + 1
        if nothing == WINDOW:
            waiting, surged = [], False
        if surges:
            kept += [*waiting, text]
            waiting, surged = [], True
        elif text and surged:
            waiting.append(text)
    return kept


def extract(html: str | None) -> str:
    """The main text of a page: its blocks, white space made single, joined by two newlines."""
    return "\n\n".join(main_lines(lines_of(html))) if html else ""


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``html`` and with the main text as column ``name``.

    A null or empty page, and one without text, gives an empty text. Whole pages are read; time and
    memory are in proportion to a page's length. Repeated rows stay. A column that is called like
    ``name`` already is replaced, others are passed on. Nothing is shuffled, so a
    lost executor repeats its own tasks only.
    """
    others = [c for c in pages.columns if c not in (html, name)]
    given = pages.select(*others, F.col(html).alias(name))
    at = len(others)

    def work(batches):
        for batch in batches:
            out, held, start = [], 0, 0
            for i in range(batch.num_rows):
                out.append(extract(batch.column(at)[i].as_py()))
                held += len(out[-1])
                if held >= BATCH or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(out, pa.string())], [*others, name])
                    out, held, start = [], 0, i + 1

    return given.mapInArrow(work, given.schema)
