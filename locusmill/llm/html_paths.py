"""Main text of web pages by tag-path ratios.

The blocks of a page are grouped by their path of tags from the root.  Each path
gets its text outside links and its punctuation, per block; both ratios are
fused, smoothed over the order of the blocks and cut at a share of their
standard deviation.  The smallest element that holds most of the text of the
chosen paths is the article, an ``article`` or ``main`` element before others.
Inside it the paths are scored, smoothed and cut once more.  What stands between
passing blocks stays too, and what stands before or after them in an ``article``
or ``main`` without a division of its own, lists of links excepted.  A name that may mean boilerplate or not weighs against an element: it
then needs half the ratio of the article's own text.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import each_batch

SHARE = 0.8
THRESHOLD = 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"  # drawings and formulas may be closed in their own tag
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody tfoot thead title tr ul caption".split()
)
_ENDS_P = _BLOCK - frozenset(("button", "option", "optgroup", "legend"))
_DROPPED = frozenset("head nav footer aside form menu button dialog fieldset title search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_DIVISIONS = frozenset(("div", "section"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HINT = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar|side-?bar|"
    r"aside|footer|foot|masthead|site-?header|page-?header|header|comment\w*|disqus\w*|respond|repl(?:y|ies)|cookie\w*|consent|gdpr|notice\w*|"
    r"popup|modal|overlay|newsletter|subscri\w*|signup|sign-?up|login|share|sharing|social|related|recommend\w*|widget\w*|"
    r"pagination|pager|toolbar|copyright|legal|disclaimer|skip|search\w*|form|alert\w*|outbrain|taboola)(?=$|[-_ 0-9])",
    re.I,
)
_DOUBTFUL = frozenset(
    "ad ads alert aside banner copyright disclaimer foot footer form header legal login notice notices promo recommend recommended related "
    "search share skip social widget".split()
)
"""Hints that also begin or end the names of an article's own parts: alone they are boilerplate, as a part of a longer name they weigh."""
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、¿¡\"'()]")


@dataclass
class Block:
    """One block: text, characters outside links, elements around it (outermost first), boilerplate or not, outermost doubtful element (0: none)."""

    text: str
    own: int
    path: str
    elements: tuple[int, ...]
    names: tuple[str, ...]
    boilerplate: bool
    doubtful: int


_OPEN, _DOUBT, _OUT = 0, 1, 2


def _name_hint(value: str, heading: bool) -> int:
    """What a class or id says; a doubtful word says nothing about a heading."""
    worst = _OPEN
    for name in value.split():
        for m in _HINT.finditer(name):
            word = m.group().strip("-_ ").lower()
            if word not in _DOUBTFUL:
                return _OUT
            if not heading:
                worst = max(worst, _OUT if word == name.lower() else _DOUBT)
    return worst


def _hinted(name: str, attrs: str, inside: bool) -> int:
    """Whether an element is boilerplate by its tag, role, class, id or because it is hidden, or may be by its name."""
    if name in _DROPPED or (name == "header" and not inside):
        return _OUT
    if not attrs.strip():
        return _OPEN
    worst = _OPEN
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not (inside and name == "header"):
            hint = _name_hint(value, inside and name in _HEADINGS)
            worst = max(worst, hint if inside else 2 * hint)
        if key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return _OUT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _OUT
    return min(worst, _OUT)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; unclosed and misplaced tags are tolerated."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, number, hint
    parts: list[str] = []
    own, number, links = 0, 0, 0

    def flush() -> None:
        nonlocal own
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            solid = [e for e in stack if e[0] in _BLOCK]
            out.append(Block(
                text, min(own, len(text)), ">".join(e[0] for e in solid), tuple(e[1] for e in solid),
                tuple(e[0] for e in solid), any(e[2] == _OUT for e in stack),
                next((e[1] for e in stack if e[2] == _DOUBT), 0),
            ))
        own = 0

    def close(k: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if not links:
                own += len(piece)
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br" or name in ("td", "th"):
            parts.append(" ")
        if name in _BLOCK:
            flush()
        if m["close"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None and (name in _BLOCK or not any(e[0] in _BLOCK for e in stack[k:])):
                close(k)
            continue
        if name in _ENDS_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if k is not None:
                close(k)
        if name in ("li", "dt", "dd", "tr", "option"):
            same = ("dt", "dd") if name in ("dt", "dd") else (name,)
            stop = {"li": ("ul", "ol", "menu"), "tr": ("table",)}.get(name, ("dl", "select"))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in stop:
                    break
        if name in _VOID or m["attrs"].endswith("/") and name not in _BLOCK:
            continue
        number += 1
        links += name == "a"
        inside = any(e[0] in ("article", "main") for e in stack)
        stack.append((name, number, _hinted(name, m["attrs"], inside)))
    if at < len(page):
        rest = page[at:]
        parts.append(rest)
        if not links:
            own += len(rest)
    flush()
    return out


def _ratios(blocks: list[Block], group: list) -> dict:
    """Fused ratio of each group of blocks: text and punctuation per block."""
    length, marks, count = {}, {}, {}
    for b, g in zip(blocks, group):
        length[g] = length.get(g, 0) + b.own
        marks[g] = marks.get(g, 0) + len(_PUNCTUATION.findall(b.text)) * b.own / max(len(b.text), 1)
        count[g] = count.get(g, 0) + 1
    return {g: length[g] / count[g] * (1 + marks[g] / count[g]) for g in count}


def path_scores(blocks: list[Block]) -> list[float]:
    """Fused and smoothed ratio of each block's path."""
    ratio = _ratios(blocks, [b.path for b in blocks])
    raw = [ratio[b.path] for b in blocks]
    kernel = (0.25, 0.5, 0.25)
    n = len(raw)
    return [sum(w * raw[min(max(i + d, 0), n - 1)] for d, w in zip((-1, 0, 1), kernel)) for i in range(n)]


def _cut(score: list[float]) -> float:
    mean = sum(score) / len(score)
    return THRESHOLD * math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))


def _passing(blocks: list[Block]) -> set[str]:
    """Paths whose blocks score the cut or more on average."""
    score = path_scores(blocks)
    total, count = {}, {}
    for b, s in zip(blocks, score):
        total[b.path] = total.get(b.path, 0) + s
        count[b.path] = count.get(b.path, 0) + 1
    cut = _cut(score)
    return {p for p in total if total[p] >= cut * count[p]}


def _container(blocks: list[Block], chosen: list[int]) -> tuple[int | None, bool]:
    """The innermost element with at least ``SHARE`` of the chosen text, an article, then a main element, before others; whether it is one of these."""
    total = sum(blocks[i].own for i in chosen)
    held: dict[int, int] = {}
    depth: dict[int, int] = {}
    kind: dict[int, int] = {}
    for i in chosen:
        for d, e in enumerate(blocks[i].elements):
            held[e] = held.get(e, 0) + blocks[i].own
            depth[e] = d
            kind[e] = {"article": 2, "main": 1}.get(blocks[i].names[d], 0)
    good = [e for e, n in held.items() if n >= SHARE * total and n > 0]
    best = max(good, key=lambda e: (kind[e], depth[e], -e), default=None)
    return best, best is not None and kind[best] > 0


def _settled(blocks: list[Block], element: int) -> list[Block]:
    """The element's blocks that are no boilerplate; those of a doubtful element where it has half the ratio of the others' passing paths or more."""
    inner = [b for b in blocks if element in b.elements and not b.boilerplate]
    sure, unsure = [b for b in inner if not b.doubtful], [b for b in inner if b.doubtful]
    if not unsure or not sure:
        return inner
    passing, ratio = _passing(sure), _ratios(sure, [b.path for b in sure])
    usual = sorted(ratio[b.path] for b in sure if b.path in passing)
    least = usual[len(usual) // 2] / 2 if usual else 0
    own = _ratios(unsure, [b.doubtful for b in unsure])
    return [b for b in inner if not b.doubtful or own[b.doubtful] >= least]


def _links_only(blocks: list[Block]) -> list[bool]:
    """Blocks mostly of links in an element mostly of links."""
    own: dict[int, int] = {}
    size: dict[int, int] = {}
    for b in blocks:
        for e in b.elements:
            own[e] = own.get(e, 0) + b.own
            size[e] = size.get(e, 0) + len(b.text)
    around = [b.elements[-2] if len(b.elements) > 1 else None for b in blocks]
    return [2 * b.own < len(b.text) and (e is None or 2 * own[e] < size[e]) for b, e in zip(blocks, around)]


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; "" where there is none."""
    found = blocks_of(page) if page else []
    known = [b for b in found if not b.boilerplate]
    open_ = [b for b in known if not b.doubtful] or known
    if not open_:
        return ""
    score = path_scores(open_)
    cut = _cut(score)
    chosen = [i for i, s in enumerate(score) if s >= cut and 2 * open_[i].own >= len(open_[i].text)]
    chosen = chosen or list(range(len(open_)))
    element, named = _container(open_, chosen)
    inner = _settled(found, element) if element is not None else [open_[i] for i in chosen]
    paths = _passing(inner)
    passing = [i for i, b in enumerate(inner) if b.names and b.names[-1] in _HEADINGS or b.path in paths and 2 * b.own >= len(b.text)]
    if not passing:
        return ""
    links, held = _links_only(inner), set(passing)

    def stays(i: int, b: Block) -> bool:
        if i in held or links[i]:
            return i in held
        return passing[0] < i < passing[-1] or named and _DIVISIONS.isdisjoint(b.names[b.elements.index(element) + 1 :])

    return "\n".join(b.text for i, b in enumerate(inner) if stays(i, b))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, one row per input row.

    NULL and empty pages, and pages without an article, have an empty text.
    Whole pages are read however long they are.  Other columns are left out.
    """

    def run(batch: pa.RecordBatch):
        text = [main_text(page) for page in batch.column("_html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(each_batch(run), "page_id long, url string, text string, n_chars long")
