"""Main-text extraction from raw HTML.

Standard-library parser events are streamed into block lines. Each line gets a
text-to-tag ratio, the ratios are smoothed by a Gaussian along the page, and lines
above a threshold form the content cluster. The cluster selects the container that
holds it; the text is every block of that container that isn't page furniture.

Elements that are furniture by their tag, role or hiding have no ratio. Names of classes
and ids are only hints: they lower the ratio of their lines, and count for nothing in
the ancestors of the densest line; a form is as such a name. Blocks of links within the
container are dropped by their share of linked text, but for those after an article's
beginning; a link around whole paragraphs is no link's caption. Furniture within a line, as a
button, is left out of it without cutting it. Articles side by side are kept together.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section table ul".split())
#: Elements that begin a line; all others, unknown ones too, are within one.
BLOCKS = CLOSES_P | frozenset("caption colgroup frameset head legend noframes search summary tbody td tfoot th thead title tr".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table td th ul menu".split())
#: Elements that lines belong to; content is looked for in the first kind, blocks of links in the second.
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
LISTS = frozenset("ul ol dl menu table div section p".split())
FURNITURE = frozenset("applet aside audio button canvas datalist dialog fieldset footer head iframe input label legend map menu nav noframes noscript object optgroup option progress script select style svg template textarea title video".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names that mostly mark furniture, and by how much they lower the ratio of their lines.
STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion "
    "sidebar sidebars widget widgets share sharing social "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar "
    "footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond".split()
)
STRONG = 0.05
#: Names that are found in articles too.
WEAK_NAMES = frozenset("aside banner related recommended notice notices alert register reply replies discussion feedback".split())
WEAK = 0.5
#: What such names are joined with; any other part, as in with-sidebar, comments-open or related-work, makes it a name of something else.
NEUTRAL_PARTS = frozenset("area block bottom box container group holder inner item items left links list outer panel post posts reader readers right section site slot top unit user users wrap wrapper".split())
#: A link around two lines and so many characters or more is a passage, not a link's caption.
PASSAGE = 300
#: Articles beside the one with the most content, of which they have this share or more, are kept with it.
BESIDE = 0.25
#: Elements whose names are looked at: text blocks only for the strong ones.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figure figcaption".split())
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _furniture(tag: str, attrs: list, in_article: bool) -> bool:
    """Whether an element is furniture by its tag, its role or because it is hidden."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for key, value in attrs:
        if key == "role" and (value or "").lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and value and HIDING.search(value):
            return True
    return False


def _hint(tag: str, attrs: list) -> float:
    """By how much the names of an element lower the ratio of its lines; a form is as a strong name, as whole pages may stand in one."""
    factor = STRONG if tag == "form" else 1.0
    if tag in ("html", "body", "main"):
        return factor
    for key, value in attrs:
        if key not in ("class", "id"):
            continue
        for name in (value or "").split():
            parts = {x.lower() for x in NAME_PARTS.findall(name)} - NEUTRAL_PARTS
            if parts and parts <= STRONG_NAMES | WEAK_NAMES or name.lower() == "header" and tag != "article":
                strong = not parts.isdisjoint(STRONG_NAMES)
                if strong or tag not in TEXT_BLOCKS and tag != "article":
                    factor = min(factor, STRONG if strong else WEAK)
    return factor


class Line(NamedTuple):
    """A block line: its text, the characters of it in links, its tags, whether it is furniture, and the element it belongs to."""

    text: str
    linked: int
    tags: int
    dropped: bool
    node: int


class BlockLines(HTMLParser):
    """Turns parser events into block lines, and the elements around them into a tree of parent pointers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: open elements: tag, within furniture, element, within an article, number of the link around or 0, whether its text is left out of a line
        self.stack: list[tuple[str, bool, int, bool, int, bool]] = [("", False, 0, False, 0, False)]
        self.open: Counter[str] = Counter()
        self.kinds, self.parents, self.hints = ["body"], [0], [1.0]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.links = 0
        #: of each link that a line's text ends in, the lines and characters of it, and which lines
        self.link_lines: dict[int, list[int]] = {}
        self.last_link = 0

    def parse_html_declaration(self, i):
        """Marked sections, whatever is in them, end at the next '>', as in a browser."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def updatepos(self, i, j):
        return j  # line numbers aren't needed

    def parse_starttag(self, i):
        """Tags without attributes take a short way."""
        plain = PLAIN_TAG.match(self.rawdata, i)
        if plain is None or plain[1]:
            return super().parse_starttag(i)
        tag = plain[2].lower()
        self.handle_starttag(tag, [])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else PLAIN_TAG.match(self.rawdata, i)
        if plain is None or not plain[1]:
            return super().parse_endtag(i)
        self.handle_endtag(plain[2].lower())
        return plain.end()

    def flush(self) -> None:
        if self.parts or self.tags:
            text = " ".join("".join(self.parts).split())
            if text or self.tags:
                _, dropped, node, _, _, _ = self.stack[-1]
                if text and 2 * self.linked >= len(text):
                    self.link_lines.setdefault(self.last_link, []).append(len(self.lines))
                self.lines.append(Line(text, min(self.linked, len(text)), self.tags, dropped, node))
            self.parts, self.tags, self.linked = [], 0, 0

    def cut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        self.open.subtract(x[0] for x in self.stack[k:])
        del self.stack[k:]

    def close_tag(self, tags: set[str] | frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name in tags:
                self.cut(k)
                return
            if name in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.flush()
            if tag in CLOSES_P:
                self.close_tag({"p"})
            if tag in SELF_CLOSING:
                self.close_tag(SELF_CLOSING[tag])
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        _, dropped, node, article, link, _ = self.stack[-1]
        dropped_here = dropped or _furniture(tag, attrs, article)
        hint = _hint(tag, attrs) if attrs or tag == "form" else 1.0
        mute = self.stack[-1][5] or not block and dropped_here and not dropped  # as a button or a hidden word: its line goes on after it
        if not block and hint < 1 and not mute:
            self.flush()
        if tag in CONTAINERS or tag in LISTS or hint < 1:
            self.parents.append(node)
            node = len(self.kinds)
            self.kinds.append(tag)
            self.hints.append(hint)
        if tag == "a" and not link:
            self.links += 1
            link = self.links
        self.stack.append((tag, dropped_here, node, article or tag in ("article", "main"), link, mute))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if tag in BLOCKS or self.stack[k][2] != self.stack[k - 1][2] and not self.stack[k][5]:
                    self.flush()
                self.cut(k)
                return
            if tag not in BLOCKS and self.stack[k][0] in SCOPES:
                return

    def handle_data(self, data):
        if self.stack[-1][5]:
            return
        self.parts.append(data)
        if self.stack[-1][4]:
            self.last_link = self.stack[-1][4]
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.flush()
        for held in self.link_lines.values():
            if len(held) >= 2 and sum(len(self.lines[k].text) for k in held) >= PASSAGE:
                for k in held:
                    self.lines[k] = self.lines[k]._replace(linked=0)


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with a kernel of three sigmas, renormalised at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel, "full")[reach:-reach] / np.convolve(np.ones_like(ratio), kernel, "full")[reach:-reach]


class Page:
    """The lines of a page and what they add up to by element."""

    def __init__(self, parsed: BlockLines):
        self.kinds, self.hints, lines = parsed.kinds, parsed.hints, parsed.lines
        self.parent = parsed.parents
        self.text = [x.text for x in lines]
        self.node = np.array([x.node for x in lines], np.int64)
        self.chars = np.array([len(x.text) for x in lines], np.int64)
        self.linked = np.array([x.linked for x in lines], np.int64)
        self.dropped = np.array([x.dropped for x in lines], bool)
        self.ratio = np.where(self.dropped, 0.0, (self.chars - self.linked) / np.maximum(1, [x.tags for x in lines]))

    def summed(self, values: np.ndarray) -> list[float]:
        """For each element the sum of the values of its lines, those of elements within it too."""
        total = np.bincount(self.node, values, len(self.kinds)).tolist()
        for k in range(len(total) - 1, 0, -1):  # an element comes after its parent
            total[self.parent[k]] += total[k]
        return total

    def spread(self, own: list, merge) -> np.ndarray:
        """For each line what merge makes of the values of its element and all around it, from the outermost on."""
        for k in range(1, len(own)):
            own[k] = merge(own[self.parent[k]], own[k])
        return np.array(own)[self.node]

    def ancestors(self, node: int) -> set[int]:
        found = {0, node}
        while node:
            node = self.parent[node]
            found.add(node)
        return found


def densest(page: Page, sigma: float, exempt: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hints, lowered ratios and smoothed ones of each line, the hints of exempt elements counting for nothing."""
    hint = page.spread([1.0 if k in exempt else h for k, h in enumerate(page.hints)], min)
    ratio = page.ratio * hint
    return hint, ratio, smoothed(ratio, sigma)


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The main text: blocks in page order, one to a line; '' for null, empty or text-free pages."""
    if not html:
        return ""
    parsed = BlockLines()
    parsed.feed(html)
    parsed.finish()
    if not any(x.text and not x.dropped for x in parsed.lines):
        return ""
    page = Page(parsed)
    _, ratio, smooth = densest(page, sigma, set())
    # The ancestors of the densest line, of articles if there are any, are never judged by their names.
    dense = np.minimum(ratio, smooth)
    in_article = page.spread([k in ("article", "main") for k in page.kinds], lambda a, b: a or b) & (dense > 0)
    peak = int((np.where(in_article, dense, -1.0) if in_article.any() else dense).argmax())
    hint, ratio, smooth = densest(page, sigma, page.ancestors(int(page.node[peak])))
    # The threshold is the spread of the smoothed ratios; the cluster can't be empty.
    least = min(smooth.std(), smooth.max())
    chosen = (smooth >= least) & (ratio > 0)
    if not chosen.any():
        chosen = ratio > 0
    if not chosen.any():
        return ""
    held = page.summed(np.where(chosen, page.chars * hint, 0.0))
    articles = [k for k, kind in enumerate(page.kinds) if kind in ("article", "main") and 2 * held[k] >= held[0]]
    if articles:
        box = max(articles, key=lambda k: (held[k], k))
    else:
        box = max(k for k, kind in enumerate(page.kinds) if kind in CONTAINERS and held[k] >= 0.9 * held[0] - 1e-6)
    # Articles beside it are kept too; of those within or around others, the outermost.
    around = page.ancestors(box)
    boxes = {box} | {k for k, kind in enumerate(page.kinds) if articles and kind == "article" and k not in around and held[k] >= BESIDE * held[box]}
    within = page.spread([k in boxes for k in range(len(page.kinds))], lambda a, b: a or b)
    if not articles and page.kinds[box] not in ("div", "section", "center", "td"):
        # No container of its own: from the first to the last line of the cluster, and blocks without many links beside them.
        beside = ~page.dropped & (2 * page.linked <= page.chars)
        first, last = np.flatnonzero(chosen)[[0, -1]]
        while first > 0 and beside[first - 1]:
            first -= 1
        while last + 1 < len(beside) and beside[last + 1]:
            last += 1
        within &= (np.arange(len(within)) >= first) & (np.arange(len(within)) <= last)
    # Named blocks stay if their own density carries them: a strong name must do so without its neighbours, and be denser than all that has no name.
    densest_plain = float(page.ratio[hint == 1].max(initial=0.0))
    carried = np.where(hint <= STRONG, (np.minimum(ratio, smooth) >= least) & (page.ratio > densest_plain), smooth >= least)
    links = _link_blocks(page, box)
    if page.kinds[box] == "article":
        links &= np.arange(len(links)) < int(np.flatnonzero(chosen & within)[0] if (chosen & within).any() else 0)  # lists of links after an article's beginning are part of it
    keep = within & ~page.dropped & ((hint == 1) | carried) & ~links
    return "\n".join(t for t, k in zip(page.text, keep) if k and t)


def _link_blocks(page: Page, box: int) -> np.ndarray:
    """Lines within an element of two or more linked lines, half of whose text or more is links, and in runs of three or more such lines; not the box and what is around it."""
    heavy = (page.linked * 2 >= page.chars) & (page.chars > 0)
    around = page.ancestors(box)
    chars, linked, lines = page.summed(page.chars), page.summed(page.linked), page.summed(heavy & ~page.dropped)
    block = [k not in around and kind in LISTS and lines[k] >= 2 and 2 * linked[k] >= chars[k] for k, kind in enumerate(page.kinds)]
    in_block = page.spread(block, lambda a, b: a or b)
    some = np.flatnonzero(page.chars > 0)
    run = heavy[some]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], run.astype(np.int8), [0]])))
    out = in_block.copy()
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= 3:
            out[some[a:b]] = True
    return out


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null or empty html, and pages of furniture only, give an empty text; broken markup is read as
    far as a browser would, and never fails. Repeated rows each give a row, an empty table none, and
    columns but these three are not read. Of lines equally dense, the first is the densest. One page
    is parsed at a time, in memory and time linear in its length.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(h, sigma) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
