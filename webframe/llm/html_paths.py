"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its tag path: the elements from the root to the block, inline
ones left out. Per path the text length, the punctuation and the length of link texts are added up over the
page. A path's ratio of text to blocks and its ratio of punctuation to blocks, both without link text, are
smoothed over the blocks in page order and fused by a geometric mean. Paths at or above `threshold` times
the page's mean are content. Being inside an article or main element is one more feature: such a path's score
weighs DECLARED times in the mean and DECLARED ** 2 times against it. An item of a list or a cell of a table is no block of its
own in the ratios: a path's items count once per list or table, so that long lists have no lower ratio than short ones. What
flows in one box (headings, lists, tables, paragraphs and the like in one div, section, cell or article) is judged with it:
where at least half of a box's unlinked text is content, all of it is but for blocks that are mostly links. The box of what is
inside an article is the article. Elements that are boilerplate by their tag, role, class or id (menus,
headers and footers outside an article, sidebars, notices, adverts, forms, reader comments, scripts,
styles) are left out with all they hold. A class or id is a hint only: whole names count (`sidebar`, `cookie-notice`,
`site-footer`, but not `content-sidebar-wrap` or `no-sidebar`), an element that holds an article or main element is never
left out by one, and one that holds half of the page's unlinked text or more is kept with its paths' scores HINTED times.
Where hinted elements together hold nearly all of that text, all are judged by their scores.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a
space in page order. Null and empty pages give an empty text. Markup may be broken in any way: unclosed tags
are closed with their parents, unclosed comments, scripts and styles reach to the page's end, stray end
tags are passed over. Nothing recurses, so markup may be nested to any depth. Rows are independent."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.shared import blocks_of

#: Elements that do not end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr script style noscript template iframe svg button select textarea object canvas audio video".split()
)
#: Elements whose text flows with that around them, and those of them that are one part of a list or table.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr details summary".split())
LISTS = frozenset(("ul", "ol", "dl", "table"))
ITEMS = frozenset(("li", "dt", "dd", "td", "th", "caption"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements that never hold main text; header and footer only outside an article.
BOILERPLATE = frozenset("nav aside form script style title noscript template iframe svg button select textarea dialog menu object canvas audio video noframes noembed xmp head".split())
EDGES = frozenset(("header", "footer"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond login widget skip".split()
)
#: Words that say nothing by themselves beside one of NAMES.
PLACES = frozenset("site page main primary secondary left right top bottom global box wrap wrapper container area inner block section list bar item items".split())
#: What a page must hold outside the elements left out by name, as a share of its unlinked text; the factor of a hinted path's score.
REMAINS, HINTED = 0.1, 0.25
#: What an element's start ends: (closed, as far as).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: The weight of the scores of paths inside an article or main element.
DECLARED = 4
PUNCTUATION = re.compile(r"[.,;:!?。、！？；：]")
SPACES = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{12,}|[xX][0-9a-fA-F]{12,});?")


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(LONG_REFERENCE.sub(_shortened, text) if "&#" in text else text)


def _shortened(m: re.Match) -> str:
    """A long reference without its leading zeros; beyond the last character it stays out of range."""
    digits = m.group()[2:].rstrip(";")
    mark = digits[0] if digits[0] in "xX" else ""
    digits = digits[len(mark) :].lstrip("0")
    return f"&#{mark}{digits if len(digits) < 12 else 'ffffffff' if mark else '99999999'};"


def _named(value: str) -> bool:
    """Whether one of the names in a class or id is of boilerplate, as a whole."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not NAMES.isdisjoint(words) and all(w in NAMES or w in PLACES or w.isdigit() for w in words):
            return True
    return False


def _boilerplate(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate for certain, and whether its class or id hints at it."""
    if tag in BOILERPLATE or (tag in EDGES and not inside):
        return True, False
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, False
    hinted = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if (
            name == "hidden"
            or (name == "aria-hidden" and value.lower().strip() == "true")
            or (name == "style" and NONE_SHOWN.search(value))
            or (name == "role" and value.lower().strip() in ROLES)
        ):
            return True, False
        hinted = hinted or (name in ("class", "id") and tag not in ("html", "body") and _named(value))
    return False, hinted


#: Outside all elements.
NOWHERE = ("", 0, False, False, -1, (0, 0, 0))


class Page:
    """The blocks of a page: (path, text, length of link text, inside an article, box, unit).

    Boxes and units are elements by number: the box a block flows in, and the list or table whose item it is (0: none).
    `named` has the elements with a hint, by the place of their tag: unlinked text before and in them, articles likewise.
    Those in `out` are left out, the paths of those in `low` are kept apart in `hinted`."""

    def __init__(self, source: str, out: frozenset[int] = frozenset(), low: frozenset[int] = frozenset()):
        self.out, self.low = out, low
        self.named: dict[int, list[int]] = {}
        self.plain = self.containers = 0
        self.hinted: set[int] = set()
        self.blocks: list[tuple[int, str, int, bool, int, int]] = []
        self.paths: dict[tuple[int, str, bool], int] = {}
        # tag, path, left out, in an article, place if named, and where: box, list or table, unit
        self.stack: list[tuple[str, int, bool, bool, int, tuple[int, int, int]]] = []
        self.elements = 0
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = 0
        self._read(source)

    def _flush(self) -> None:
        if self.text:
            text = SPACES.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                _, path, _, inside, _, (box, _, unit) = self.stack[-1] if self.stack else NOWHERE
                self.blocks.append((path, text, min(self.linked, len(text)), inside, box, unit))
        self.linked = 0

    def _pop(self) -> None:
        tag, _, _, _, place, _ = self.stack.pop()
        self.count[tag] -= 1
        if place >= 0:
            plain, containers = self.named[place]
            self.named[place] = [self.plain - plain, self.containers - containers]

    def _close(self, closed: set[str], until: set[str]) -> None:
        """Close the innermost element of `closed`, unless one of `until` comes first."""
        if not any(self.count.get(t) for t in closed):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if tag in closed:
                while len(self.stack) > depth:
                    self._pop()
                return
            if tag in until or (tag not in INLINE and tag not in ("p", "tr", "td", "th", "li", "dd", "dt", "option", "div")):
                return

    def _start(self, tag: str, attributes: str, place: int) -> None:
        if tag not in INLINE:
            self._flush_here()
            if not (self.stack and self.stack[-1][2]):
                if tag in ENDS:
                    self._close(*ENDS[tag])
                elif self.count.get("p"):
                    self._close_p()
        parent, path, out, inside, _, where = self.stack[-1] if self.stack else NOWHERE
        if tag in VOID:
            return
        certain, hint = (False, False) if out else _boilerplate(tag, attributes, inside)
        out, low = out or certain or place in self.out, place in self.low
        if tag not in INLINE or low:
            low = low or path in self.hinted
            path = self.paths.setdefault((path, tag, low), len(self.paths) + 1)
            if low:
                self.hinted.add(path)
        if tag in CONTAINERS and not out:
            self.containers += 1
        if hint:
            self.named[place] = [self.plain, self.containers - (tag in CONTAINERS)]
        if tag not in INLINE:
            where = self._where(tag, parent, inside, where)
        self.stack.append((tag, path, out, inside or tag in CONTAINERS, place if hint else -1, where))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _where(self, tag: str, parent: str, inside: bool, where: tuple[int, int, int]) -> tuple[int, int, int]:
        """Box, list or table, and unit in a block element."""
        self.elements += 1
        box, lists, _ = where
        if not inside and (tag not in FLOW or parent in ("td", "th")):  # a cell with blocks in it is a box
            box = self.elements
        if tag in LISTS:
            lists = self.elements
        return box, lists, lists if tag in ITEMS else 0

    def _close_p(self) -> None:
        """A block's start ends an open paragraph, with the inline elements in it."""
        depth = len(self.stack) - 1
        while depth >= 0 and self.stack[depth][0] in INLINE:
            depth -= 1
        if depth >= 0 and self.stack[depth][0] == "p":
            while len(self.stack) > depth:
                self._pop()

    def _flush_here(self) -> None:
        """End a block; what is left out never ends one around it, for none of its text was taken."""
        if not (self.stack and self.stack[-1][2]):
            self._flush()

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush_here()
        if not self.count.get(tag):
            return
        if tag in INLINE:
            # An inline end tag does not reach over block elements.
            depth = len(self.stack) - 1
            while self.stack[depth][0] != tag:
                if self.stack[depth][0] not in INLINE:
                    return
                depth -= 1
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _read(self, source: str) -> None:
        at, n, lower, none = 0, len(source), None, set()
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at and not (self.stack and self.stack[-1][2]):
                text = _decoded(source[at:lt])
                self.text.append(text)
                if self.count.get("a"):
                    self.linked += len(text)
                else:
                    self.plain += len(text.strip())
            if lt == n:
                break
            nxt = source[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            m = NAME.match(source, lt + (2 if nxt == "/" else 1))
            if not m:
                if nxt == "/":
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    if not (self.stack and self.stack[-1][2]):
                        self.text.append("<")
                    at = lt + 1
                continue
            gt = source.find(">", m.end())
            if gt < 0:
                break
            tag = m.group().lower()
            if nxt == "/":
                at = gt + 1
                self._end(tag)
                continue
            attributes = source[m.end() : gt]
            for quote in ('"', "'"):
                while attributes.count(quote) % 2 and re.search(r"=\s*" + quote, attributes) and quote not in none:
                    close = source.find(quote, gt + 1)
                    if close < 0:
                        none.add(quote)
                        break
                    far = source.find(">", close + 1)
                    if far < 0:
                        break
                    gt = far
                    attributes = source[m.end() : gt]
            at = gt + 1
            if tag == "br":
                self._flush_here()
                continue
            self._start(tag, attributes, lt)
            if tag in RAW and not attributes.endswith("/"):
                if lower is None:
                    lower = source.lower() if len(source.lower()) == n else source
                end = lower.find("</" + tag, at) if tag not in none else -1
                if end < 0:
                    none.add(tag)
                    at = n
                else:
                    at = end
        self._flush_here()
        while self.stack:
            self._pop()


def page_of(source: str) -> Page:
    """The page without the elements that are left out by their names; read again only where there are such."""
    page = Page(source)
    free = {at: plain for at, (plain, containers) in page.named.items() if not containers}
    out = frozenset(at for at, plain in free.items() if 2 * plain < max(1, page.plain))
    low = frozenset(free) - out
    if not free:
        return page
    found = Page(source, out, low)
    if found.plain < REMAINS * page.plain:
        found = Page(source, frozenset(), frozenset(free))
    return found


def main_text(source: str | None, threshold: float = 0.5, reach: int = 1) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = page_of(source)
    blocks = page.blocks
    sums: dict[int, list[int]] = {}
    units: dict[int, set[int]] = {}
    for at, (path, text, linked, _, _, unit) in enumerate(blocks):
        s = sums.setdefault(path, [0, 0])
        s[0] += len(text) - linked
        s[1] += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
        units.setdefault(path, set()).add(unit or -1 - at)
    ratio = {p: tuple((1 + x) / len(units[p]) for x in s) for p, s in sums.items()}
    order = [ratio[b[0]] for b in blocks]
    smooth: dict[int, list[float]] = {}
    for i, b in enumerate(blocks):
        near = order[max(0, i - reach) : i + reach + 1]
        own = [(a + sum(x[j] for x in near) / len(near)) / 2 for j, a in enumerate(order[i])]
        smooth.setdefault(b[0], []).append((own[0] * own[1]) ** 0.5)
    score = {p: sum(v) / len(v) * (HINTED if p in page.hinted else 1) for p, v in smooth.items()}
    whole = sum(len(b[1]) for b in blocks)
    mean = sum(score[b[0]] * (DECLARED if b[3] else 1) * len(b[1]) for b in blocks) / max(1, whole)
    content = [
        score[path] * (DECLARED**2 if inside else 1) >= threshold * mean and (inside or 2 * linked <= len(text))
        for path, text, linked, inside, _, _ in blocks
    ]
    boxes: dict[int, int] = {}  # unlinked text that is content, less that which is not
    for (path, text, linked, _, box, _), good in zip(blocks, content):
        boxes[box] = boxes.get(box, 0) + (len(text) - linked) * (1 if good else -1)
    return " ".join(
        text
        for (path, text, linked, _, box, _), good in zip(blocks, content)
        if good or (boxes[box] >= 0 and 2 * linked < len(text) and path not in page.hinted)
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))

    def run(batches):
        for part in blocks_of(batches, "html", 4 << 20):
            texts = [main_text(s) for s in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
