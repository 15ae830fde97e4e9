"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one per block of the page; scripts, menus, forms, notices and the like leave a gap of
empty lines. The sum of text lengths over a sliding window of lines surges where a text begins and dives to zero where
it ends; every line between a surge and its dive is kept, short ones too. Where the page marks its article, the runs
inside that mark are taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from biotally.llm.words import id_column, text_column

WINDOW = 3  # lines to a block of the distribution; a gap is as long
SURGE = 0.05  # of the page's largest block: where a run of lines counts as text
ENOUGH = 60  # characters of a block that count as text on any page, however large its largest block

_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|title|select|xmp"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav footer aside form head button dialog menu fieldset".split())
_MARKED = frozenset("article main".split())
_NAMED = re.compile(
    r"""\b(?:class|id|role|aria-label)\s*=\s*["']?[^"'>]*(?<![a-z0-9])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|pagination|pager|login|signup|search|comments?|comment-?list|disqus|respond|complementary|contentinfo)(?![a-z0-9])""",
    re.I,
)
_HEADER = frozenset(("header",))
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _lines(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """The lines of a page, gaps as empty ones, and whether each lies in a marked article and is a heading."""
    lines: list[str] = []
    inside: list[bool] = []
    headings: list[bool] = []
    piece: list[str] = []
    skip, depth, marked, at, heading = "", 0, 0, 0, False

    def close(gap: bool = False) -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            lines.append(text)
            inside.append(marked > 0)
            headings.append(heading)
        if gap:
            lines.extend([""] * WINDOW)
            inside.extend([marked > 0] * WINDOW)
            headings.extend([False] * WINDOW)

    for m in _TAG.finditer(page):
        if not skip and m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = (m.group(3) or m.group(6) or "").lower()
        if not name:
            continue
        ends = bool(m.group(2) or m.group(5))
        attributes = m.group(4) or m.group(7) or ""
        if skip:
            if name == skip:
                depth += -1 if ends else 1
            if depth == 0 or (name in _MARKED and not ends and skip != name) or (ends and name in ("body", "html")):  # closed, or never closed
                skip = ""
            if skip or not (name in _MARKED and not ends):
                continue
        if not ends and name not in _VOID and (name in _SKIP or (name in _HEADER and not marked) or (name not in ("body", "html", "main") and attributes and _NAMED.search(attributes))):
            close(gap=True)
            skip, depth, heading = name, 1, False
        elif name in _MARKED:
            close(gap=True)
            marked = max(0, marked + (-1 if ends else 1))
        elif name not in _INLINE:
            close()
            heading = not ends and name in _HEADING
    if not skip and at < len(page):
        piece.append(page[at:])
    close()
    return lines, inside, headings


def main_text(page: str | None) -> str:
    """The kept lines of a page, joined by line feeds; empty where it has none."""
    lines, inside, headings = _lines(page or "")
    article = any(t and i for t, i in zip(lines, inside, strict=True))
    if article:
        lines = [t if i else "" for t, i in zip(lines, inside, strict=True)]
    sizes = [len(t) for t in lines]
    run, blocks = sum(sizes[: WINDOW - 1]), []
    for i, n in enumerate(sizes):  # block i: lines i to i + WINDOW - 1
        run += sizes[i + WINDOW - 1] if i + WINDOW - 1 < len(sizes) else 0
        blocks.append(run)
        run -= n
    least = 0 if article else min(SURGE * max(blocks, default=0), ENOUGH)
    runs: list[tuple[int, int]] = []
    begin = 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or blocks[i] == 0:  # a dive: the run up to here has ended
            if begin < i:
                runs.append((begin, i))
            begin = i + 1
    text = [k for k, (a, z) in enumerate(runs) if max(blocks[a:z]) >= least]
    if not text:
        return ""
    first, last = text[0], text[-1]  # short runs between two kept ones stay
    while first > 0 and any(headings[slice(*runs[first - 1])]):
        first -= 1
    while last + 1 < len(runs) and any(headings[slice(*runs[last + 1])]):
        last += 1
    return "\n".join(t for a, z in runs[first : last + 1] for t in lines[a:z] if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page. Null html is empty; repeated rows stay; other columns are not read."""
    base = pages.select(id_column(pages, "page_id").alias("page_id"), text_column(pages, "url").alias("url"), text_column(pages, "html").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(work, "page_id long, url string, text string, n_chars long")
