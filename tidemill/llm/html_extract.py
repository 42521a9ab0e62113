"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags from the root. Text length, punctuation
and number of blocks are summed for each path; the ratio of a path is its text and punctuation for
each of its blocks. Ratios are smoothed over neighbouring blocks in page order, then fused: outside of
article and main elements paths under one parent lend each other half of theirs. Headings, lists, tables and quotes take the ratio of the paragraphs
in the container around them, unless most of their text is links outside of an article; an article's
headings take the greatest ratio of what they stand over. Being in an article or main raises the part of a
ratio that is the path's own, by the factor INSIDE, and decides nothing alone; there, smoothing at most
makes a ratio LIFT-fold, as containers do what it is for. Paths over the threshold, a share of the page's mean, are
content. Only what is no text of a page is left out before (scripts, forms, controls, hidden elements);
menus, headers, footers, sidebars, adverts and comments are paths like all others. Their elements (nav, footer, aside)
and marks lower the ratio: a class, id or role that says it as a whole ("sidebar", "ad-1",
not "post-comments" or "no-sidebar") leaves BOILERPLATE of it, one that says it less surely MARKED, but never
for an article or main element or one around it. Such paths count for as little in the page's mean.

Defined results
* null and empty html give an empty text; so do pages without a selected block.
* unclosed and misplaced tags are taken as browsers roughly do: a block element ends an open <p>, an
  end tag closes the elements opened since, a lone end tag is ignored, a lone "<" is text.
* <br> is white space, not the end of a block. White space is what str.split() cuts at.
* every row gives a row, repeated ones and null ids too; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map

#: Share of the page's mean ratio that a path needs, and what neighbours count in smoothing.
THRESHOLD, NEIGHBOUR = 0.5, 0.25
#: What is left of the ratio of text that a class, id or role marks without deciding, and of text that its
#: element or mark says to be around the main text (a long advert can have a billion times the ratio of a word).
MARKED, BOILERPLATE = 0.25, 2.0**-40
#: What an article or main element makes of a path's own ratio; what neighbours lend in smoothing is not raised,
#: nor is marked text.
INSIDE = 1.25
LIFT = 2.0

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NEVER = RAW | frozenset("head button select option".split())
AROUND = frozenset("nav aside footer menu dialog".split())
CONTENT = frozenset(("article", "main"))
#: What stands in a container beside its paragraphs, and what holds other elements there as a part of it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = HEADINGS | frozenset("p hgroup header pre address hr".split())
PARTS = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote figure figcaption details summary".split())
#: An element of these closes an open one of the group, up to the scope element.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Words of class, id and role that mark what is not main text.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)

#: A token that begins with one of these tells of a layout, not of the element.
LAYOUT = frozenset("has no non with without".split())
#: What a mark does: nothing, lower the ratio, lower it to BOILERPLATE of it, remove.
NOTHING, LOWER, SINK, REMOVE = range(4)

_OPAQUE = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_TAG = re.compile(_OPAQUE + r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: After the last ">" of a page no tag ends, so none is looked for.
_TAIL = re.compile(_OPAQUE + "|()()()()()(?!)", re.S)
#: References to characters that cannot be, too long for a number.
_HUGE = re.compile(r"&#(x?)0*([0-9a-f]{8,});?", re.I)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articlebody\b", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？]")


def _unescape(text: str) -> str:
    return entities.unescape(_HUGE.sub(lambda m: "\ufffd" if m[1] or m[2].isdigit() else m[0], text) if "&#" in text else text)


def _outside(tag: str, attributes: str) -> bool:
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in _MARK.findall(attributes):
        value = (a or b or c).lower()
        # aria-hidden is for readers aloud: such text is on the page
        if name.lower() == "hidden":
            return True
        if name.lower() == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _mark(tag: str, attributes: str, inside_content: bool) -> int:
    """What an element's name, class, id and role say of it: a token of OUTSIDE words alone sinks, one with others lowers."""
    mark = SINK if tag in AROUND or (tag == "header" and not inside_content) else NOTHING
    if not attributes or tag in ("html", "body"):
        return mark
    for name, a, b, c in _MARK.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in (a or b or c).lower().split():
                words = _WORDS.findall(token)
                # an article's own header is part of it
                known = [w in OUTSIDE and not (w == "header" and inside_content) for w in words]
                if any(known) and words[0] not in LAYOUT:
                    mark = max(mark, SINK if all(known) else LOWER)
    return mark


@dataclass
class Block:
    path: int  # number of the tag path from the root
    parent: int  # that of the path without its last tag
    content: int  # number of the article or main element it is in, or -1
    text: str
    marked: int  # NOTHING, LOWER or SINK: what the marks around all of it do
    home: int  # number of the path of the container that it is a paragraph or a part of
    inner: bool  # in a list, table or quote there
    linked: int  # characters of it in links, about
    heading: bool


def blocks(page: str) -> tuple[list[Block], list[int], list[int]]:
    """The text blocks of a page in order, without those that never are main text; the container around each
    path's parent; the path of each article or main element."""
    out: list[Block] = []
    # (tag, path, outside, content element, whether it is a block, innermost marked element, in a link)
    stack: list[tuple[str, int, bool, int, bool, int, bool]] = [("", 0, False, -1, True, 0, False)]
    # marked elements: the marked element around it, its mark, what is left of that around an article or main
    marks: list[list[int]] = [[0, NOTHING, NOTHING]]
    raw: list[tuple[int, int, list[tuple[str, int, bool]]]] = []
    numbers: dict[tuple[int, str], int] = {}
    parents = [0]
    homes, inner, heads = [0], [False], [False]
    roots: list[int] = []
    held: list[tuple[str, int, bool]] = []
    # where the open elements of each name are in the stack, and those of blocks
    places: dict[str, list[int]] = {}
    open_blocks = [0]

    def flush() -> None:
        if held:
            if any(x.strip() for x, _, _ in held):
                at = stack[open_blocks[-1]]
                raw.append((at[1], at[3], held.copy()))
            held.clear()

    def close(depth: int) -> None:
        if open_blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            gone = stack.pop()
            places[gone[0]].pop()
            if gone[4]:
                open_blocks.pop()

    def innermost(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    position, last = 0, page.rfind(">")
    while True:
        match = (_TAG if position <= last else _TAIL).search(page, position)
        text = page[position : match.start() if match else len(page)]
        if text and not stack[-1][2]:
            held.append((text, stack[-1][5], stack[-1][6]))
        if not match:
            break
        position = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        attributes = match[3] or match[6] or ""
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr") and not stack[-1][2]:
                held.append((" " if tag == "br" else "", stack[-1][5], stack[-1][6]))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, position)
            position = page.find(">", end.end()) + 1 if end else 0
            position = position or len(page)
            continue
        if tag in BLOCK:
            if stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
            if tag in SIBLINGS:
                group, scope = SIBLINGS[tag]
                depth = innermost(group)
                if depth > innermost(scope):
                    close(depth)
            flush()
        _, path, outside, content, _, around, link = stack[-1]
        outside = outside or _outside(tag, attributes)
        opens = False
        holds = not outside and (tag in CONTENT or bool(attributes and _ROLE.search(attributes)))
        mark = NOTHING if outside else _mark(tag, attributes, content >= 0)
        if holds:
            # what is around an element that holds an article holds it too
            k = around
            while k and marks[k][1] != marks[k][2]:
                marks[k][1] = marks[k][2]
                k = marks[k][0]
            mark = LOWER if mark == SINK else NOTHING
            opens = content < 0
            content = len(roots) if opens else content
        if not outside and (mark or (tag == "form" and not holds)):
            marks.append([around, REMOVE if tag == "form" and not holds else mark, mark if holds else LOWER if mark == SINK else NOTHING])
            around = len(marks) - 1
        if tag in BLOCK:
            parent, path = path, numbers.setdefault((path, tag), len(parents))
            if path == len(parents):
                parents.append(parent)
                heads.append(heads[parent] or tag in HEADINGS)
                inner.append(inner[parent] or tag in PARTS)
                homes.append(homes[parent] if inner[-1] or tag in PLAIN else path)
        if opens:
            roots.append(path)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append((tag, path, outside, content, tag in BLOCK, around, link or tag == "a"))
    flush()
    does = [NOTHING]
    for outer, mark, _ in marks[1:]:
        does.append(max(mark, does[outer]))
    for path, content, whole in raw:
        for sunk in (False, True):
            parts = [e for e in whole if does[e[1]] < REMOVE and (does[e[1]] == SINK) == sunk]
            text = " ".join(_unescape("".join(e[0] for e in parts)).split())
            if text:
                marked = SINK if sunk else LOWER if all(does[k] == LOWER for x, k, _ in parts if x.strip()) else NOTHING
                linked = sum(len(x.strip()) for x, _, link in parts if link)
                out.append(Block(path, parents[path], content, text, marked, homes[path], inner[path], linked, heads[path]))
    return out, [homes[p] for p in parents], roots


def _under(own: dict[int, Block], smooth: np.ndarray, outer: list[int], roots: list[int]) -> dict[tuple[int, int], float]:
    """The greatest ratio in each container of each article or main element, with those in it."""
    best: dict[tuple[int, int], float] = {}
    for k, b in own.items():
        if b.content >= 0:
            best[b.content, b.home] = max(best.get((b.content, b.home), 0.0), smooth[k])
    # paths have greater numbers than those around them
    waiting = [(-home, content) for content, home in best]
    heapify(waiting)
    while waiting:
        home, content = heappop(waiting)
        up = outer[-home]
        if -home <= roots[content]:
            continue
        if (content, up) not in best:
            heappush(waiting, (-up, content))
        best[content, up] = max(best.get((content, up), 0.0), best[content, -home])
    return best


def path_ratios(length: np.ndarray, punctuation: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Text of a path for each of its blocks, times one and their punctuation marks."""
    return (length / count) * (1 + punctuation / count)


def _smoothed(row: np.ndarray) -> np.ndarray:
    padded = np.concatenate((row[:1], row, row[-1:]))
    return (NEIGHBOUR * padded[:-2] + padded[1:-1] + NEIGHBOUR * padded[2:]) / (1 + 2 * NEIGHBOUR)


def select(found: list[Block], outer: list[int], roots: list[int]) -> list[Block]:
    """Smooth, fuse and threshold the ratios of the blocks' paths."""
    if not found:
        return []
    paths = {p: k for k, p in enumerate(dict.fromkeys((b.content, b.path, b.marked) for b in found))}
    of = np.array([paths[b.content, b.path, b.marked] for b in found])
    level = np.array([m for _, _, m in paths])
    share = np.array([1.0, MARKED, BOILERPLATE])[level]
    count = np.bincount(of)
    length = np.bincount(of, [len(b.text) for b in found])
    ratio = path_ratios(length, np.bincount(of, [len(_PUNCTUATION.findall(b.text)) for b in found]), count)
    row = ratio[of]
    # what is around the main text lends it nothing, and takes nothing from it
    for own in (level[of] == SINK, level[of] != SINK):
        row[own] = _smoothed(row[own])
    smooth = np.bincount(of, row) / count
    smooth = np.where([c >= 0 for c, _, _ in paths], np.minimum(smooth, LIFT * ratio), smooth)
    sunk = level == SINK
    mean = np.average(np.where(sunk, smooth, smooth * share), weights=np.where(sunk, share, 1.0) * count)
    inside = np.array([c >= 0 and not m for c, _, m in paths])
    smooth += (INSIDE - 1) * inside * np.minimum(ratio, smooth)
    fused = smooth.copy()
    own = {k: b for b, k in zip(found, of.tolist()) if b.marked != SINK}
    best: dict[int, float] = {}
    for k, b in own.items():
        if b.content < 0:
            best[b.parent] = max(best.get(b.parent, 0.0), smooth[k])
    for k, b in own.items():
        if b.content < 0:
            fused[k] = max(fused[k], best[b.parent] / 2)
    # parts of a container take what its paragraphs have
    linked = np.bincount(of, [b.linked for b in found])
    anchor: dict[tuple[int, int], float] = {}
    for k, b in own.items():
        if not b.inner:
            anchor[b.content, b.home] = max(anchor.get((b.content, b.home), 0.0), smooth[k])
    under = _under(own, smooth, outer, roots)
    for k, b in own.items():
        if b.content >= 0 or (b.path != b.home and 2 * linked[k] <= length[k]):
            fused[k] = max(fused[k], anchor.get((b.content, b.home), 0.0))
        if b.heading:
            fused[k] = max(fused[k], under.get((b.content, b.home), 0.0))
    keep = fused * share >= THRESHOLD * mean
    return [b for b, k in zip(found, of) if keep[k]]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in select(*blocks(page or "")))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return arrow_map(base, run, "id long, url string, text string, n_chars long", "html").withColumnsRenamed({"id": id_column, "url": url_column})
