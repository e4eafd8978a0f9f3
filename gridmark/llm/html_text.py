"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with its root-to-leaf tag path; container elements are told apart by their classes, so
that two columns of divs are two paths.  Every block is a candidate, those of menus, notices and comments too; only what
is no text is left out (scripts, styles, controls).  Text length without links and punctuation are aggregated per tag path
and divided by the number of the path's blocks, smoothed along the page and fused (length times one plus punctuation).

An element that says that it is furniture lowers the score of the paths below it: nav, footer, aside, form, header (but
not one inside article or main that holds a heading), or a class, id or role that is a name of ``FURNITURE`` or a compound of such names and
``QUALIFIERS`` alone (site-header, comment-list; not related-work).  Inside article and main only ``STRONG`` and ``WEAK`` names
do.  A lowered path keeps ``LOWER`` of its fused ratio (``LESS`` for WEAK names), which counts up to the best one of the paths
that aren't lowered, so it can't win by length.  A name doesn't lower what holds an article or main element that isn't
furniture itself, or the page's first h1 where there is none, or more than four fifths of the text around it.

Paths that reach ``SHARE`` of the best score are content paths; all their blocks are text.  Their neighbours join them if
nothing lowers them: blocks of the article or main element around a content block; elsewhere headings before a content
block, list items behind one, and short blocks beside one in the same element.  Outside article and main, paths that are
mostly link text go, never a single block.

Character references are decoded, white space within a block becomes one space, blocks are joined by a newline in
page order.  Null or empty html gives an empty text; equal pages give equal texts; other columns of a table play no
part.  Reading is linear in the page's length, however broken its markup: tags without an end are text, a quote without
an end is no quote.  Rows are independent and a page is the most that is held.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = re.compile(r"<(?=/?[a-zA-Z]|[!?])")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r">|=\s*[\"']")
MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements by what they are to a reader.
RAW = frozenset("script style noscript template svg math iframe object textarea title".split())
OUT = frozenset("head button select dialog menu canvas audio video".split()) | RAW
#: Elements that are furniture whatever they hold, and one that is unless it holds the article.
ASIDE, FORM = frozenset("nav footer aside header".split()), "form"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption hr address details summary center "
    "nav header footer aside form fieldset head".split()
)
#: Names of class, id and role that are furniture's everywhere, those that the text's own parts may have too,
#: and names that are furniture's outside article and main.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored cookie cookies consent gdpr popup modal newsletter subscribe "
    "breadcrumb breadcrumbs comment comments disqus sidebar nav navbar navigation pagination banner notice notices login signup copyright replies".split()
)
WEAK = frozenset("promo subscription share sharing social related recommended".split())
FURNITURE = STRONG | WEAK | frozenset("menu header footer aside alert overlay reply pager widget toolbar search legal".split())
#: What stands beside such a name in a compound and says where or what part it is.
QUALIFIERS = frozenset(
    "site page main top bottom left right global primary secondary box bar block list item items area wrap wrapper container section inner outer links link buttons button slot unit text body content "
    "title form thread reader user post posts article articles story entry div".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset(("article", "main"))
LISTS, SHORT = frozenset(("ul", "ol", "dl")), HEADINGS | {"li", "dt", "dd"}
SHARE, LINKS = 0.15, 0.6
#: What a lowered path keeps of its ratio: below SHARE, and above it.
LOWER, LESS = 0.1, 0.4
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Containers, which paths tell apart by their classes.
CONTAINER = frozenset("div section main article ul ol dl table figure center details".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_LONG_REFERENCE = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{8,});?")


def decoded(text: str) -> str:
    """``text`` with its character references decoded; numbers that no character has become U+FFFD."""
    return unescape(_LONG_REFERENCE.sub("�", text)) if "&" in text else text


def scanned(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order; comments, declarations and
    the insides of RAW elements are skipped.  Every position is passed a fixed number of times."""
    at, text, quotes, missing = 0, 0, True, set()

    def find(mark: str, start: int) -> int:
        place = -1 if mark in missing else html.find(mark, start)
        if place < 0:
            missing.add(mark)
        return place

    while sign := SIGN.search(html, at):
        at = sign.start()
        name, end = NAME.match(html, at + 1), -1
        if name:
            stop = name.end()
            while quotes and (m := STOP.search(html, stop)):
                if m[0] == ">":
                    end = m.start()
                    break
                closed = find(m[0][-1], m.end())
                stop = closed + 1 if closed >= 0 else m.end()
            else:
                quotes, end = False, find(">", name.end())  # quotes that swallow the rest of the page are none
        elif html.startswith("<!--", at):
            end = find("-->", at + 4)
            end = end + 2 if end >= 0 else len(html) - 1
        elif html.startswith("<![CDATA[", at):
            end = find("]]>", at + 9)
            end = end + 2 if end >= 0 else len(html) - 1
        elif html.startswith(("<!", "<?"), at):
            end = find(">", at + 2)
            end = end if end >= 0 else len(html) - 1
        if end < 0:
            at += 1
            continue
        if at > text:
            yield "text", html[text:at], ""
        at = text = end + 1
        if name:
            tag, attributes = name[2].lower(), html[name.end() : end]
            if not name[1] and tag in RAW and not attributes.endswith("/"):
                closing = _RAW_END[tag].search(html, at)
                end = find(">", closing.end()) if closing else -1
                at = text = end + 1 if end >= 0 else len(html)
            else:
                yield ("close" if name[1] else "open"), tag, attributes
    if text < len(html):
        yield "text", html[text:], ""


def _name_marks(name: str, known: frozenset[str]) -> set[str]:
    """The furniture's names in a class or id that is made of such names, qualifiers and numbers alone."""
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    return {x for x in parts if x in known} if all(x in FURNITURE or x in QUALIFIERS for x in parts) else set()


def lowered(attributes: str, inside: bool) -> float:
    """What a class, id, role or label leaves of a path's ratio; ``inside`` article or main."""
    names = {x for a, b, c in MARKS.findall(attributes) for name in (a or b or c).lower().split() for x in _name_marks(name, STRONG | WEAK if inside else FURNITURE)}
    return LOWER if names - WEAK else LESS if names else 1.0


@dataclass
class Page:
    """Blocks (element, text, characters of link text, weight) of a page, and its tree of block elements; element 0 is above
    the root.  Elements are numbered in page order, so a parent's number is smaller than its children's; ``named`` are the
    article and main elements that aren't furniture."""

    tags: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    paths: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int, float]] = field(default_factory=list)
    names: dict[tuple[int, str], int] = field(default_factory=dict)
    named: set[int] = field(default_factory=set)

    def add(self, tag: str, attributes: str, parent: int) -> int:
        self.tags.append(tag)
        self.parent.append(parent)
        label = f"{tag} {' '.join(sorted(''.join(m.groups('')).lower().split()))}" if tag in CONTAINER and (m := CLASS.search(attributes)) else tag
        self.paths.append(self.names.setdefault((self.paths[parent], label), len(self.names) + 1))
        return len(self.tags) - 1

    def inherited(self, own) -> list[int]:
        """For every element the nearest one of it and its ancestors that ``own`` holds for, 0 if none."""
        out = [0] * len(self.tags)
        for e in range(1, len(out)):
            out[e] = e if own(e) else out[self.parent[e]]
        return out


@dataclass
class _Mark:
    around: int  # the mark around it, 0 if none
    base: int  # the article or main element around it, 0 if none
    before: int  # text before it
    factor: float  # what it leaves of a ratio
    fixed: bool  # it, or a mark around it, is furniture whatever it holds
    head: bool = False  # a header inside article or main
    weight: int = 0
    stays: bool = False


def parsed(html: str) -> Page:
    """The page's blocks, with what its furniture's names leave of their paths' ratios."""
    page, stack, count = Page(), [], defaultdict(int)  # stack: (tag, element or 0, mark or 0)
    found: list[tuple[int, list[tuple[str, bool, int]]]] = []
    pieces: list[tuple[str, bool, int]] = []
    marks, named, starts, weights = [_Mark(0, 0, 0, 1.0, False, stays=True)], [0], {}, {}
    element = mark = hidden = total = 0
    titled = False

    def close() -> None:
        nonlocal pieces
        if pieces:
            found.append((element, pieces))
            pieces = []

    def pop(depth: int) -> None:
        nonlocal element, mark, hidden
        for tag, own, sign in reversed(stack[depth:]):
            count[tag] -= 1
            if own:
                close()
                element = page.parent[own]
            if sign:
                marks[sign].weight = total - marks[sign].before
                mark = marks[sign].around
            if own and named[-1] == own:
                weights[own] = total - starts[own]
                named.pop()
        del stack[depth:]
        hidden = hidden if hidden <= depth else 0

    for kind, tag, attributes in scanned(html):
        if kind == "text":
            if not hidden:
                text = decoded(tag)
                pieces.append((text, count["a"] > 0, mark))
                total += 0 if marks[mark].fixed else sum(map(len, text.split()))
        elif kind == "close":
            if count[tag] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag in VOID:
            if tag in BLOCK:
                close()
            elif tag == "br" and not hidden:
                pieces.append((" ", False, mark))
        else:
            own = sign = 0
            if tag in BLOCK:
                same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in (*same, "p"):
                        pop(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
                close()
                element = own = page.add(tag, attributes, element)
            if not hidden and tag in OUT:
                hidden = len(stack) + 1
            elif not hidden:
                inside = bool(named[-1])
                marks[mark].stays |= tag in HEADINGS and marks[mark].head
                head = tag == "header" and inside
                factor = LOWER if tag in ASIDE or tag == FORM else lowered(attributes, inside) if attributes and tag not in ("html", "body", *HEADINGS) else 1.0
                factor = 1.0 if factor == LESS and tag not in BLOCK else factor  # words of a sentence aren't weighed alone
                if factor < 1 and not (tag == "main" or tag == "article" and factor == LESS):
                    marks.append(_Mark(mark, named[-1], total, factor, marks[mark].fixed or tag in ASIDE and not head, head))
                    mark = sign = len(marks) - 1
                elif tag in NAMED or tag == "h1" and not titled and not page.named:
                    outer = mark
                    while outer and not marks[outer].stays:
                        marks[outer].stays = not marks[outer].fixed
                        outer = marks[outer].around
                    titled = titled or tag == "h1" and not marks[mark].fixed
                    if tag in NAMED:
                        page.named.add(own)
                        starts[own] = total
                        named.append(own)
            stack.append((tag, own, sign))
            count[tag] += 1
    pop(0)
    close()
    if any(weights.values()):  # an article: text beside it can't outweigh it
        judged = [m for m in marks[1:] if m.base]
    else:
        judged = marks[1:]
    for m in judged:
        m.stays = m.stays or 5 * m.weight > 4 * (weights.get(m.base, total) if m.base else total)
    shown = [1.0]
    for m in marks[1:]:
        shown.append(shown[m.around] if m.stays and not m.fixed else max(shown[m.around] * m.factor, 1e-9))
    for owner, parts in found:
        for weight in dict.fromkeys(shown[sign] for _, _, sign in parts):
            own = [(text, link) for text, link, sign in parts if shown[sign] == weight]
            if text := " ".join("".join(text for text, _ in own).split()):
                page.blocks.append((owner, text, min(len(text), sum(len(x) for x, link in own if link)), weight))
    return page


def fused(paths: list, lengths: list[int], marks: list[int]) -> list[float]:
    """The fused ratio at every block: length and punctuation of its path by the path's blocks, each smoothed with the
    block before and after (weights 1, 2, 1), the one times one plus the other."""
    long, mark, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, n, m in zip(paths, lengths, marks, strict=True):
        long[p] += n
        mark[p] += m
        nodes[p] += 1
    own = [(long[p] / nodes[p], mark[p] / nodes[p]) for p in paths]
    out = []
    for i in range(len(own)):
        near = [(own[j], 2 if j == i else 1) for j in range(max(0, i - 1), min(len(own), i + 2))]
        weight = sum(w for _, w in near)
        a, b = (sum(x[k] * w for x, w in near) / weight for k in (0, 1))
        out.append(a * (1 + b))
    return out


def _beside(page: Page, chosen: set[int]) -> list[bool]:
    """Whether a block is a heading or list item with only such between it and a content block inside its parent (the
    list's, for an item); headings look ahead, items back."""
    out, last = [False] * len(page.blocks), list(range(len(page.tags)))
    for e in range(len(last) - 1, 0, -1):
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    anchor = [0] * len(page.tags)
    for e in range(1, len(anchor)):
        p = page.parent[e]
        anchor[e] = anchor[p] if page.tags[p] in LISTS or page.tags[p] in SHORT else p
    for order, tags in ((range(len(out)), SHORT - HEADINGS), (range(len(out) - 1, -1, -1), HEADINGS)):
        near = -1
        for i in order:
            e = page.blocks[i][0]
            if i in chosen:
                near = e
            elif page.tags[e] in SHORT:
                if near >= 0 and page.tags[e] in tags:
                    out[i] = not anchor[e] or anchor[e] <= near <= last[anchor[e]]
            else:
                near = -1
    return out


def paths(page: Page) -> list[tuple[int, float]]:
    """The path of every block: that of its element, and how far it is lowered."""
    return [(page.paths[e], weight) for e, _, _, weight in page.blocks]


def chosen(page: Page) -> set[int]:
    """Numbers of the blocks on content paths."""
    own = paths(page)
    ratios = fused(own, [len(text) - link for _, text, link, _ in page.blocks], [len(PUNCTUATION.findall(text)) for _, text, _, _ in page.blocks])
    best: dict[tuple[int, float], float] = defaultdict(float)
    for p, f in zip(own, ratios, strict=True):
        best[p] = max(best[p], f)
    free = max(weight for _, weight in best)
    top = max(f for (_, weight), f in best.items() if weight == free)
    content_paths = {p for p, f in best.items() if min(f, top) * (p[1] / free) >= SHARE * top}
    return {i for i, p in enumerate(own) if p in content_paths}


def content(html: str) -> str:
    """The main text of a page."""
    page = parsed(html)
    if not page.blocks:
        return ""
    own, best = paths(page), chosen(page)
    length, links = defaultdict(int), defaultdict(int)
    for p, (_, text, link, _) in zip(own, page.blocks, strict=True):
        length[p] += len(text)
        links[p] += link
    article = page.inherited(page.named.__contains__)
    inside = page.inherited({article[page.blocks[i][0]] for i in best if article[page.blocks[i][0]]}.__contains__)
    direct = {page.parent[page.blocks[i][0]] for i in best} - {e for e, tag in enumerate(page.tags) if tag in ("", "html", "body")}
    free = max(weight for _, weight in own)
    kept = []
    for i, ((e, text, _, weight), beside) in enumerate(zip(page.blocks, _beside(page, best), strict=True)):
        near = weight == free and (beside or inside[e] or page.parent[e] in direct)
        if (i in best or near) and (article[e] or links[own[i]] < LINKS * length[own[i]]):
            kept.append(text)
    return "\n".join(kept)


def main_text(html: Column | str) -> Column:
    """The main text of an html column, empty where there is none."""

    @F.arrow_udf("string")
    def extracted(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in pages:
            yield pa.array((content(x.as_py()) if x.is_valid else "" for x in column), pa.string())

    return extracted(html)
