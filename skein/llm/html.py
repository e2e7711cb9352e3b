"""Main text of web pages by the distribution of text over line blocks.

One forward scan strips the markup into lines, one for each block of the page. Lines of
menus, headers, footers, adverts and the like are taken out first, so that they end
nothing; lines that are mostly link text count as empty. Text lengths are summed over a
sliding window of lines. The page's own mean sum gives a height: where the sum surges
to it is the start of a region, where it dives below it the end.

If the region with the most text touches an article or main element, the main text is
all that such elements hold, the headings right above them, and any text outside them
that is nearly as much as the largest region. Else it is all between the first surge
and the last dive, and the other lines of the box (the innermost div, section, cell or
body) that holds most of the dense text, so that short lines at the ends of an article
stay; lines of links stay only between lines of text that do.

A class, id or role marks a part beside the article by a whole word of its value. An
article or main isn't marked unless it is inside another; nor is a form, dialog,
header, aside or marked part that holds most of the page's text, unless it is outside
an article or main that has text itself, or holds reader comments below a headline.

The scan is linear in the page, whatever is unclosed or stray in it: a tag whose quotes
never close ends at the next ``>``, and from then on quotes are not looked at; what is
behind the last ``>`` and looks like a tag is cut off; an end tag without an open
element costs nothing; the end of a script, style, title or textarea is searched once.

Defined results: a null, empty or text-free html gives the empty string; white space is
one space inside a block; a ``<`` that opens no tag is text; references to numbers of
more than seven digits give U+FFFD; repeated rows are handled each for itself; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import pick

WINDOW = 3  #: lines in a block
HEIGHT = 0.15  #: surge and dive, as a share of the page's mean block sum (each sum weighted by itself)
SECOND = 0.5  #: text outside the article counts from this share of the largest region's
HOME = 0.5  #: share of the dense text that the article's box holds
LINK_SHARE = 0.6
#: Elements whose content is no text; that never hold the article; that start a line. Fixed values.
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|head|title|textarea|select|option|button"
AROUND = "nav|header|footer|aside|form|menu|dialog"
BLOCK = "address|article|blockquote|body|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|h1|h2|h3|h4|h5|h6|hr|html|li|main|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
#: Words in a class, id or role that mark a part beside the article. Fixed values.
BESIDE = "ad|ads|advert|advertisement|adverts|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|login|sidebar|sidenav|menu|navbar|nav|navigation|breadcrumb|breadcrumbs|pagination|pager|footer|masthead|share|sharing|social|related|recommended|comment|comments|respond|replies|disqus|widget|toolbar|copyright|search|complementary|contentinfo"

#: The same of several words, in one class, id or role. Fixed values.
COMPOUNDS = "ad-banner|ad-box|ad-container|ad-slot|ad-unit|ad-wrapper|adsbygoogle|google-ad|cookie-banner|cookie-bar|cookie-consent|cookie-notice|cookie-popup|consent-banner|newsletter-box|newsletter-form|newsletter-signup|subscribe-box|subscribe-form|sign-up|signup-form|login-box|login-form|search-box|search-form|searchform|comment-form|comment-list|comment-section|commentlist|comments-area|comments-section|comment-respond|disqus-thread|related-articles|related-content|related-links|related-posts|related-stories|recommended-articles|recommended-posts|share-bar|share-buttons|share-links|sharing-buttons|social-buttons|social-icons|social-links|social-media|social-share|site-footer|page-footer|site-header|page-header|site-nav|site-navigation|site-menu|main-menu|main-nav|main-navigation|nav-bar|nav-links|nav-menu|post-navigation|top-nav|left-sidebar|right-sidebar|side-bar|sidebar-left|sidebar-right|sidebar-widget|widget-area|promo-box|modal-dialog"
#: Those of both lists that mark what readers wrote. Fixed values.
COMMENTS = "comment|comments|respond|replies|disqus|comment-form|comment-list|comment-section|commentlist|comments-area|comments-section|comment-respond|disqus-thread"

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/>])([^\s=\"'/>]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)")
_NUMBER = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
_BLOCKS, _AROUND, _HIDDEN = (frozenset(x.split("|")) for x in (BLOCK, AROUND, HIDDEN))
_BESIDE, _COMMENTS = frozenset(f"{BESIDE}|{COMPOUNDS}".split("|")), frozenset(COMMENTS.split("|"))
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HOLDERS = frozenset("div section ul ol li p table td tr span figure dl article main".split())
_MAIN = frozenset(("article", "main"))
_BOXES = frozenset("html body article main section div center table td th fieldset details".split()) | _AROUND
_OUTER = frozenset(("", "html", "body"))
_SAME = frozenset("p li td tr dt dd option".split())  #: an element that ends an open one of the same name
_RAW = frozenset("script style title textarea".split())  #: content without tags
_ENDS = {name: re.compile(f"</{name}", re.I) for name in _RAW}
_TRACKED = _BLOCKS | _AROUND | _HIDDEN | _HOLDERS
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a head may hold, and parts that stay beside the article whatever their size.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ALWAYS = frozenset("nav footer menu".split())
_UNCLOSED = _ALWAYS | {"header"}


def _marked(name: str, attributes: str, held: bool) -> int:
    """1 for a part beside the article, 2 for reader comments, else 0. ``held``: inside an article or main; there, a further article may be a comment or a teaser."""
    if name in _AROUND:
        return 1
    if not attributes or name not in _HOLDERS or name in _MAIN and not held:
        return 0
    words = {w.replace("_", "-") for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for w in m[2].strip("\"'").lower().split()}
    return 2 if words & _COMMENTS else 1 if words & _BESIDE else 0


class _Page:
    """The page's lines and parts, filled by one scan."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, int, int, bool]] = []  # text, its length or 0 for links, held by an article or main, part, box, heading
        self.parts: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # name, mark, held, the part around it; 0 is the page
        self.boxes: list[tuple[str, int]] = [("", 0)]  # name, the box around it
        self.open: list[tuple[str, int, int]] = []  # name, the part and the box around it
        self.counts: dict[str, int] = {}
        self.part = self.box = self.holders = self.hidden = self.in_link = self.linked = 0
        self.head = -1  # where the open head is
        self.fresh = True
        self.heading = False
        self.pieces: list[str] = []
        self.scan(page)
        self.end_line()

    def text(self, piece: str) -> None:
        if not self.hidden:
            self.pieces.append(piece)
            self.linked += len(piece) if self.in_link else 0

    def end_line(self) -> None:
        if self.pieces:
            whole = "".join(self.pieces)
            if "&" in whole:
                whole = html.unescape(_NUMBER.sub("�", whole))
            line = " ".join(whole.split())
            if line:
                links = self.linked > LINK_SHARE * sum(map(len, self.pieces))
                self.lines.append((line, 0 if links else len(line), self.holders > 0, self.part, self.box, self.heading))
            self.pieces.clear()
        self.linked = 0

    def close(self, depth: int) -> None:
        for name, part, box in reversed(self.open[depth:]):
            self.part, self.box = part, box
            self.holders -= name in _MAIN
            self.hidden -= name in _HIDDEN
            self.counts[name] -= 1
        del self.open[depth:]
        if self.head >= depth:
            self.head = -1

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "a":
            self.in_link = 0 if closing else 1
        elif name == "br":
            self.text(" ")
        if name not in _TRACKED:
            return
        if name in _BLOCKS or name in _AROUND:
            self.end_line()
            self.heading = name in _HEADINGS and not closing
        if self.head >= 0 and not closing and name not in _IN_HEAD:  # the end tag of the head may be omitted
            self.end_line()
            self.close(self.head)
        if closing:
            if self.counts.get(name):
                depth = len(self.open) - 1
                inline = name not in _BLOCKS and name not in _AROUND and name not in _HIDDEN
                while self.open[depth][0] != name:
                    if inline and self.open[depth][0] in _BLOCKS:
                        return  # a stray end of a span ends no block
                    depth -= 1
                self.close(depth)
        elif name not in _EMPTY and not attributes.endswith("/"):
            if name in _MAIN and self.fresh:  # an unclosed menu before the article ends here
                self.fresh = False
                self.close(next((i for i, (n, _, _) in enumerate(self.open) if n in _UNCLOSED), len(self.open)))
            if name in _SAME and self.open and self.open[-1][0] == name:
                self.close(len(self.open) - 1)
            self.open.append((name, self.part, self.box))
            self.counts[name] = self.counts.get(name, 0) + 1
            if mark := _marked(name, attributes, self.holders > 0):
                self.parts.append((name, mark, self.holders > 0, self.part))
                self.part = len(self.parts) - 1
            if name in _BOXES:
                self.boxes.append((name, self.box))
                self.box = len(self.boxes) - 1
            self.holders += name in _MAIN
            self.hidden += name in _HIDDEN
            if name == "head" and self.head < 0:
                self.head = len(self.open) - 1

    def scan(self, page: str) -> None:
        at, last, quotes, endless = 0, page.rfind(">"), True, set()
        while (lt := page.find("<", at)) >= 0:
            if lt > at:
                self.text(page[at:lt])
            at = lt + 1
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                self.text(page[lt + 9 :] if end < 0 else page[lt + 9 : end])
                at = len(page) if end < 0 else end + 3
            elif not (sign := page[at : at + 2]) or not (sign[0] in "!?" or sign.lstrip("/")[:1].isalpha() and sign.lstrip("/")[:1].isascii()):
                self.text("<")
            elif lt > last:  # a tag that the end of the page cuts off
                at = len(page)
            elif sign[0] in "!?":
                at = page.find(">", lt) + 1
            else:
                m = _TAG.match(page, lt) if quotes else None
                if m is None:
                    quotes = False
                    m = _PLAIN_TAG.match(page, lt)
                at, name = m.end(), m[2].lower()
                if name in _RAW and not m[1] and not m[3].endswith("/") and name not in endless:
                    end = _ENDS[name].search(page, at)
                    behind = page.find(">", end.end()) if end else -1  # where there is none, no later end tag closes either
                    if behind >= 0:
                        at = behind + 1
                    elif name in ("script", "style"):
                        at = len(page)
                    else:
                        endless.add(name)
                elif name not in _RAW:
                    self.tag(name, bool(m[1]), m[3])
        self.text(page[at:])


def page_lines(page: str) -> tuple[list[tuple[str, int, bool, int, bool]], list[tuple[str, int]]]:
    """The page's blocks in order but those beside the article, as (text, the length that counts, held by an article or main, box, heading), and the boxes as (name, the box around it)."""
    p = _Page(page)
    sizes, beside = [0] * len(p.parts), [False] * len(p.parts)
    for _, n, _, i, _, _ in p.lines:
        sizes[i] += n
    has_article = any(held and n and not i for _, n, held, i, _, _ in p.lines)
    headline = any(heading and not i for *_, i, _, heading in p.lines)
    # a part's number is above that of the one around it
    for i in range(len(p.parts) - 1, 0, -1):
        sizes[p.parts[i][3]] += sizes[i]
    for i, (name, mark, held, around) in enumerate(p.parts):
        small = 2 * sizes[i] <= sizes[0] or mark == 2 and headline and sizes[i] < sizes[0]
        beside[i] = i > 0 and (beside[around] or name in _ALWAYS or small or has_article and not held)
    return [(text, n, held, box, heading) for text, n, held, i, box, heading in p.lines if not beside[i]], p.boxes


def regions(lengths: list[int], window: int = WINDOW, height: float = HEIGHT) -> list[tuple[int, int]]:
    """(first, behind last) line of each run whose sums of ``window`` lines from there on reach the height."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    total = sum(sums)
    out: list[tuple[int, int]] = []
    if total:
        least = height * sum(s * s for s in sums) / total
        start = None
        for i, s in enumerate([*sums, -1]):
            if s >= least and start is None:
                start = i  # surge
            elif s < least and start is not None:  # dive
                out.append((start, i))
                start = None
    return out


def _home(lines: list, boxes: list[tuple[str, int]], dense: list[tuple[int, int]]) -> set[int]:
    """The innermost box with most of the dense text, and those in it unless it is the whole page's."""
    held = [0] * len(boxes)
    for a, b in dense:
        for _, n, _, box, _ in lines[a:b]:
            held[box] += n
    for i in range(len(boxes) - 1, 0, -1):
        held[boxes[i][1]] += held[i]
    home = max((i for i in range(len(boxes)) if held[i] >= HOME * held[0]), default=0)
    inside = {home}
    if boxes[home][0] not in _OUTER:
        for i in range(home + 1, len(boxes)):
            if boxes[i][1] in inside:
                inside.add(i)
    return inside


def main_text(page: str | None) -> str:
    lines, boxes = page_lines(page or "")
    dense = regions([n for _, n, _, _, _ in lines])
    if not dense:
        return ""
    sizes = [sum(n for _, n, _, _, _ in lines[a:b]) for a, b in dense]
    most = max(sizes)
    a, b = dense[sizes.index(most)]
    if any(held for _, _, held, _, _ in lines[a:b]):
        keep = [held for _, _, held, _, _ in lines]
        for a, b in dense:
            outside = sum(n for _, n, held, _, _ in lines[a:b] if not held)
            for i in range(b - 1, a - 1, -1):
                above = lines[i][4] and i + 1 < len(lines) and keep[i + 1]
                keep[i] = keep[i] or above or outside >= SECOND * most and lines[i][1] > 0
    else:
        first, last, home = dense[0][0], dense[-1][1], _home(lines, boxes, dense)
        while lines[first][3] not in home and WINDOW * lines[first][1] * (dense[0][1] - dense[0][0]) < sizes[0]:
            first += 1  # short lines of other boxes, which the first window reached over
        keep = [n > 0 and (first <= i < last or box in home) for i, (_, n, _, box, _) in enumerate(lines)]
        first, behind = keep.index(True), len(keep) - keep[::-1].index(True)
        keep = [k or first <= i < behind and n == 0 for i, (k, (_, n, *_)) in enumerate(zip(keep, lines, strict=True))]
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points; no shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
