"""Main text of HTML pages by line-block distribution.

Markup is stripped into one line per block. The lengths of the lines are summed over sliding
windows of ``WINDOW`` lines. Text surges where the sums reach a share of the page's largest,
and dives where they have fallen to nothing; what lies between is kept: the stretch with most
text, and others of at least ``ALSO_SHARE`` of its text.

Structure does nothing but scale what a line counts. Lines within the article element that
has most text count several times, and so do all their links; text that stands in a bare
container counts less on pages with paragraphs; where there is none, lines
outside of the container with most of the text count nothing, but for headlines and for
text that is as dense or looks alike. Lines that are mostly links count nothing outside of an article
element, but stay where text surges around them. Lines of menus, notices, adverts, comments
and the like, told by their element or by the words of a container's name, are no lines of
the page's text at all, unless the container holds an article element or much of the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches

WINDOW = 3
#: Text surges at this share of the page's largest window sum.
SURGE_SHARE = 0.25
#: How many times a line within an article or main element counts; one of another block.
OWN_WEIGHT, BLOCK_WEIGHT = 16, 4
#: A stretch, an article, or a container beside the main one, of at least this share of the largest's
#: text is text of the page too.
ALSO_SHARE = 0.25
#: A container beside the main one is as dense from this share of its largest window sum.
DENSE_SHARE = 0.5
#: A container is the main one if so much of the text lies in it.
MAIN_SHARE = 2 / 3
#: A container within an article that its name speaks against stays from this share of the article's text.
INNER_SHARE = 0.2
#: A line of at least so much link text is a link.
LINK_SHARE = 0.6

_tags = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_raw = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_names = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements that a head may have, and those whose content is never text of the page.
_HEAD = frozenset("base link meta noscript script style template title".split())
_SKIPPED = frozenset("head script style noscript template svg math canvas object iframe button select option datalist audio video map title textarea".split())
#: Elements that are something else than the article, unless they hold it.
_OTHER = frozenset("nav footer aside form dialog menu".split())
#: Elements whose names say what they hold: those that hold blocks.
_HOLDERS = frozenset("div section article main header aside nav footer ul ol dl form table tbody tr td details fieldset figure center menu dialog".split())
#: Words that say so wherever they stand in a name.
_ALWAYS = frozenset(
    """ad ads advert adverts advertisement adslot advertising sponsor sponsored promo promos promotion promoted banner-ad cookie cookies consent gdpr newsletter
    comment comments disqus respond replies discussion discussions breadcrumb breadcrumbs related recommended recommendations teaser teasers
    sidebar pagination pager navbar navigation social sharing popup modal overlay""".split()
)
#: Words that say so if the whole name is made of them and of places.
_ALONE = frozenset(
    """banner nav menu header footer aside widget notice notices notification alert subscribe subscription signup login
    share pages toolbar search complementary contentinfo dialog masthead""".split()
)
_PLACES = frozenset("area bar block bottom box container content form global inner left links list main outer page right section site slot top unit wrap wrapper".split())
#: Words that turn a name into a state of something else.
_STATES = frozenset("has no not with without is open closed on off enabled disabled allowed count hide show".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement adslot advertising sponsor sponsored promo promos promotion promoted".split())
_COMMENTS = frozenset("comment comments disqus respond replies discussion discussions".split())
_HEADERS = frozenset("header masthead banner".split())
_OWN = frozenset(("article", "main"))
_BOXES = frozenset("body div article main td section".split())


class Line(NamedTuple):
    """A block: its text, how much of it is link text, the numbers of its container, of the
    article and of the doubtful container that it is in (0: none), and its element."""

    text: str
    linked: int
    box: int
    own: int
    other: int
    tag: str


class Other(NamedTuple):
    """A container that is something else than the article by its element or name."""

    parent: int
    own: int  # the article that it is in
    talks: bool  # it holds comments
    heads: bool  # it is a header


class Page:
    """The lines of a page in order, and the containers they stand in."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.box_parent, self.box_look = [0], [""]
        self.others = [Other(0, 0, False, False)]
        self.holds = {0}  # the others that hold an article element


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is something else than the article, whether it holds comments, and
    whether it is a header; ``inside``: it is in an article."""
    if tag in ("html", "body"):
        return False, False, False
    found = talks = heads = False
    if attributes:
        for m in _names.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = [p for p in re.split("[-_]+", name) if p]
                if not _STATES.isdisjoint(parts):
                    continue
                if tag not in _HOLDERS:
                    found |= not _ADVERTS.isdisjoint(parts)
                    continue
                alone = [p for p in parts if p in _ALONE and not (p == "header" and inside)]
                alone = alone if all(p in _ALONE or p in _PLACES for p in parts) else []
                talks |= not _COMMENTS.isdisjoint(parts)
                heads |= not _HEADERS.isdisjoint(alone)
                found |= bool(alone) or not _ALWAYS.isdisjoint(parts)
    if tag in _OWN:
        return talks, talks, False
    hidden = bool(attributes) and _hidden.search(attributes) is not None
    heads |= tag == "header" and not inside
    return found or hidden or heads or tag in _OTHER, talks, heads and not hidden


def parse(source: str) -> Page:
    """The lines of a page; time is linear in it."""
    page = Page()
    pieces: list[str] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # element, whether it is skipped; container, article and doubtful container outside of it
    depth: Counter[str] = Counter()
    box = own = other = n_own = skipped = linked = 0
    block = ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.lines.append(Line(text, linked, box, own, other, block))
            pieces.clear()
        linked = 0

    def close(size: int) -> None:
        """End open elements, the innermost first, until ``size`` are left."""
        nonlocal box, own, other, skipped, block
        while len(stack) > size:
            top, skip, *outside = stack.pop()
            depth[top] -= 1
            if skip:
                skipped -= 1
            elif not skipped and top not in _INLINE:
                flush()
            box, own, other = outside
        block = next((x[0] for x in reversed(stack[-4:]) if x[0] not in _INLINE), "")

    at, n = 0, len(source)
    while at < n:
        m = _tags.search(source, at)
        stop = m.start() if m else n
        if stop > at and not skipped:
            piece = html.unescape(source[at:stop])
            pieces.append(piece)
            if depth["a"]:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] if m[2] else m[4]:
            if depth[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in _raw:
            end = _raw[tag].search(source, at)
            at = end.end() if end else n
            continue
        if depth["head"] and tag not in _HEAD:  # where other elements begin the head has ended
            close(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if tag == "br":
            pieces.append(" ")
        elif tag not in _INLINE and not skipped:
            flush()
        if tag in _VOID or attributes.endswith("/") and tag in ("path", "circle"):
            continue
        if tag in ("p", "li", "a") and depth[tag]:  # it ends where the next begins
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag and stack[k][0] in _INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == tag:
                close(k)
        skip = tag in _SKIPPED or tag in _INLINE and bool(attributes) and _hidden.search(attributes) is not None
        stack.append((tag, skip, box, own, other))
        depth[tag] += 1
        skipped += skip
        if skipped or tag in _INLINE:
            continue
        block = tag
        doubtful, talks, heads = _kind(tag, attributes, own > 0)
        if doubtful:
            page.others.append(Other(other, own, talks, heads))
            other = len(page.others) - 1
        if tag in _OWN and not talks:
            k = other
            while k not in page.holds:
                page.holds.add(k)
                k = page.others[k].parent
            n_own += 1
            own = n_own if tag == "article" or not own else own
        if tag in _BOXES:
            page.box_parent.append(box)
            page.box_look.append(f"{tag} {attributes.strip()}" if attributes.strip() else "")
            box = len(page.box_parent) - 1
    close(0)
    flush()
    return page


def _left_out(page: Page) -> list[bool]:
    """For each of ``page.others``, whether its lines are no text of the page."""
    n = len(page.others)
    held, total, owned = [0] * n, 0, Counter()
    headlines = [0] * n
    for x in page.lines:
        held[x.other] += len(x.text)
        headlines[x.other] += x.tag == "h1"
        owned[x.own] += len(x.text)
        total += len(x.text)
    for k in range(n - 1, 0, -1):
        held[page.others[k].parent] += held[k]
        headlines[page.others[k].parent] += headlines[k]
    any_own = any(x.own and not x.other for x in page.lines)
    out = [False] * n
    for k in range(1, n):
        o = page.others[k]
        if o.talks:
            keeps = k in page.holds
        elif o.own:
            keeps = k in page.holds or headlines[k] > 0 or held[k] >= INNER_SHARE * owned[o.own]
        else:
            keeps = k in page.holds or not any_own and 2 * held[k] > total
        out[k] = out[o.parent] or not keeps
    return out


def weighed(page: Page) -> tuple[list[Line], list[int]]:
    """The lines that may be text of the page, and what each counts."""
    out = _left_out(page)
    lines = [x for x in page.lines if not out[x.other]]
    bare = any(x.tag == "p" for x in lines)  # then text without such an element is less likely a page's
    sizes = []
    for x in lines:
        if x.own:
            sizes.append(len(x.text) * OWN_WEIGHT)
        elif x.linked >= LINK_SHARE * len(x.text):
            sizes.append(int(x.tag == "p"))  # a paragraph stays next to text, a menu does not
        else:
            sizes.append(len(x.text) * (1 if bare and x.tag in _BOXES else BLOCK_WEIGHT))
    if not any(sizes):  # nothing but links
        sizes = [len(x.text) for x in lines]
    mass: Counter[int] = Counter()
    for x, s in zip(lines, sizes, strict=True):
        mass[x.own] += s
    own = max(mass, key=lambda k: (mass[k], -k), default=0)
    if own:
        kept = [k for k, x in enumerate(lines) if x.own and mass[x.own] >= ALSO_SHARE * mass[own]]
    else:
        kept = _beside_no_article(page, lines, sizes)
    lines, sizes = [lines[k] for k in kept], [sizes[k] for k in kept]
    head = _headline(page, out)
    if head and not any(x.tag == "h1" for x in lines):
        lines, sizes = [head, *lines], [len(head.text) * (OWN_WEIGHT if own else BLOCK_WEIGHT), *sizes]
    return lines, sizes


def _headline(page: Page, out: list[bool]) -> Line | None:
    """The only h1 of a page, in a header that is left out and has no other line: the article's."""
    found = [x for x in page.lines if x.tag == "h1"]
    if len(found) != 1 or not out[found[0].other] or not page.others[found[0].other].heads:
        return None
    alone = sum(x.other == found[0].other for x in page.lines) == 1 and not found[0].linked
    return found[0] if alone else None


def regions(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, after last) of the stretches between surges and dives: each goes back from its
    surge to where its text begins, and on to where it dives."""
    ahead = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    surge = SURGE_SHARE * max(ahead, default=0)
    found, i = [], 0
    while i < len(ahead):
        if not ahead[i] or ahead[i] < surge:
            i += 1
            continue
        first = next(k for k in range(i, len(sizes)) if sizes[k])
        while first and any(sizes[max(0, first - WINDOW) : first]):
            first -= 1
        dive = first
        while dive < len(sizes) and any(sizes[dive : dive + WINDOW]):
            dive += 1
        found.append((first, dive))
        i = dive
    return found


def main_text(source: str | None, stretches: Callable[[list[int]], list[tuple[int, int]]] = regions) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none."""
    lines, sizes = weighed(parse(source or ""))
    found = stretches(sizes)
    mass = [sum(sizes[a:z]) for a, z in found]
    kept = [(a, z) for (a, z), m in zip(found, mass, strict=True) if m >= ALSO_SHARE * max(mass)]
    return "\n".join(lines[k].text for a, z in kept for k in range(a, z) if sizes[k] or not _in_link_list(lines, sizes, k))


def _beside_no_article(page: Page, lines: list[Line], sizes: list[int]) -> list[int]:
    """The lines that count on a page without an article element: those of the container that
    holds most of the text, of containers around it, and of others that are as dense or look alike."""
    parent = page.box_parent
    held = [0] * len(parent)
    for x, s in zip(lines, sizes, strict=True):
        held[x.box] += 0 if x.own else s
    for b in range(len(parent) - 1, 0, -1):
        held[parent[b]] += held[b]
    main = max(b for b in range(len(parent)) if held[b] >= MAIN_SHARE * held[0])  # the innermost: children have larger numbers
    around, b = {0}, main
    while b:
        around.add(b)
        b = parent[b]
    within = [False] * len(parent)
    within[main] = True
    for b in range(main + 1, len(parent)):
        within[b] = within[parent[b]]
    kept = {k for k, x in enumerate(lines) if not x.own and (within[x.box] or x.box in around)}
    top = max((sum(sizes[k : k + WINDOW]) for k in sorted(kept)), default=0)
    beside: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        if k not in kept and not x.own:
            beside.setdefault(x.box, []).append(k)
    for b, rows in beside.items():
        own = [sizes[k] for k in rows]
        dense = max(sum(own[i : i + WINDOW]) for i in range(len(own))) >= DENSE_SHARE * top
        if dense or page.box_look[b] and page.box_look[b] == page.box_look[main]:
            kept.update(rows)
        else:
            kept.update(k for k in rows if lines[k].tag == "h1")
    return sorted(kept)


def _in_link_list(lines: list[Line], sizes: list[int], k: int) -> bool:
    """Whether a line that is a link stands next to another one in a list."""
    near = [j for j in (k - 1, k + 1) if 0 <= j < len(lines) and not sizes[j] and lines[j].box == lines[k].box]
    return lines[k].tag in ("li", "ul", "ol", "dd", "td") and bool(near)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text string, n_chars long`` for every row, from the whole HTML.

    Null and empty pages have the empty text. Null ids, null addresses and repeated rows
    are kept; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
