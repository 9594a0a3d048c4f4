"""Main text of web pages from parser events.

The standard library's parser streams events; block elements cut the page into lines. A line's
text-to-tag ratio is its characters over its tags; the ratios are smoothed by a Gaussian, and lines
above a threshold (a share of the page's standard deviation) form the content clusters. The clusters
choose the region: from the page down, the container that holds nearly all characters of the clusters
(half of them where it is marked as an article). Names and elements that never hold main text (menus,
footers, adverts, reader comments and the like) only cut inside the region; one that wraps nearly the
whole text isn't cut. Brief lines of the region stay, but for plain containers without a cluster at its edges.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .base import map_arrow, table

SIGMA = 1.0
SHARE = 0.5
#: Share of the clusters' characters that a container must hold to become the region: plain ones, and those marked as articles.
HOLDS, HOLDS_MARKED = 0.9, 0.5
#: A named element is a wrapper, not cut, if it holds over half of the clusters and what is left outside all cuts is under this share.
LEFT = 0.1

#: Elements and names (fixed values of this operator).
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of the page at all.
UNSEEN = frozenset("audio canvas datalist embed head iframe noscript object script select style svg template textarea title video".split())
CUT = frozenset("aside button dialog footer form header menu nav option".split())
CONTAINERS = frozenset("article body center div fieldset form html main section table tbody td tr".split())
MARKED = frozenset(["article", "main"])
RAW = frozenset(["script", "style"])
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|dialog|disclaimer|footer|foot|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pagination|pager|popup|privacy|promo|promoted|recommended|related|replies|reply|respond|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSED_BY = {"head": BLOCKS - {"title", "noscript"}, "p": BLOCKS - {"br", "button"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects the lines (text, tags, block) and the blocks (parent, tag, cut: 0 no, 1 by element, 2 by name, marked) of a page; block 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, unseen, block
        self.blocks: list[tuple[int, str, int, bool]] = [(0, "", 0, False)]
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.count: Counter[str] = Counter()
        # from where on the rest holds no angle bracket, and no end of a comment: no text is searched twice in vain
        self.last_bracket = self.endless = 1 << 60

    def parse_html_declaration(self, i: int) -> int:
        """A marked section of an unknown kind is a comment up to the next angle bracket, as in browsers."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1

    def goahead(self, end: bool) -> None:
        self.last_bracket, self.endless = self.rawdata.rfind(">"), 1 << 60  # places count from the rest's beginning
        super().goahead(end)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if i >= self.endless:
            return -1
        at = super().parse_comment(i, report)
        if at < 0:
            self.endless = i
        return at

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if i < self.last_bracket else -1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if i < self.last_bracket else -1

    def _cut(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                _, unseen, block = self.open[-1] if self.open else ("", False, 0)
                if not unseen:
                    self.lines.append((text, self.tags, block))
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._cut()
            while self.open and tag in _CLOSED_BY.get(self.open[-1][0], ()):
                self._pop()
        elif tag in UNSEEN:
            self._cut()
        if tag in VOID:
            return
        _, unseen, block = self.open[-1] if self.open else ("", False, 0)
        marks = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")} if attrs else {}
        unseen = unseen or tag in UNSEEN or bool(marks) and ("hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", ""))
        cut = 0
        if marks and tag not in ("body", "html"):
            cut = 2 * (marks.get("role", "") in _OUT_ROLES or bool(_OUT_NAMES.search(f"{marks.get('class', '')} {marks.get('id', '')}")))
        if tag in CUT:
            cut = 2 if tag == "form" else 1  # a form may wrap a whole page
        marked = tag in MARKED or marks.get("role") in ("main", "article")
        if tag in BLOCKS or cut or marked:
            if tag not in BLOCKS:
                self._cut()
            self.blocks.append((block, tag, cut, marked))
            block = len(self.blocks) - 1
        self.open.append((tag, unseen, block))
        self.count[tag] += 1

    def _pop(self) -> None:
        self.count[self.open.pop()[0]] -= 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in UNSEEN:
            self._cut()
        if tag in VOID or not self.count[tag]:
            return
        while self.open:
            last, _, block = self.open[-1]
            if last not in BLOCKS and (not (outer := self.open[-2:-1]) or outer[0][2] != block):
                self._cut()  # an inline element with a block of its own
            self._pop()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][0] not in RAW:
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over two deviations on either side, weights renewed at the ends."""
    reach = np.arange(-int(2 * sigma + 0.5), int(2 * sigma + 0.5) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    weigh = np.convolve(np.ones(len(ratios)), kernel)[len(reach) // 2 :][: len(ratios)]
    return np.convolve(ratios, kernel)[len(reach) // 2 :][: len(ratios)] / weigh


def clusters(lines: list[tuple[str, int, int]], sigma: float, share: float) -> np.ndarray:
    """Which lines are above the threshold of the smoothed text-to-tag ratios."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    return smooth(ratios, sigma) >= share * float(ratios.std())


def _upward(values: list, blocks: list) -> list:
    """Sums over each block and all blocks inside it; a block's number is above its parent's."""
    total = list(values)
    for b in range(len(blocks) - 1, 0, -1):
        total[blocks[b][0]] += total[b]
    return total


def _is_out(blocks: list, spared: set[int]) -> list[bool]:
    out = [False] * len(blocks)
    for b in range(1, len(blocks)):
        out[b] = out[blocks[b][0]] or blocks[b][2] > 0 and b not in spared
    return out


def region(blocks: list, mass: list, sizes: list) -> list[int]:
    """The block that holds the clusters: down from the page while one container inside holds enough of them; where blocks marked as
    articles lie side by side, all that hold half as much as the heaviest."""
    heaviest: dict[int, int] = {}
    articles: dict[int, list[int]] = {}
    for b in range(1, len(blocks)):
        if blocks[b][1] in CONTAINERS or blocks[b][3]:
            up = blocks[b][0]
            if up not in heaviest or mass[b] > mass[heaviest[up]]:
                heaviest[up] = b
            if blocks[b][3]:
                articles.setdefault(up, []).append(b)
    at = 0
    while (b := heaviest.get(at)) is not None:
        peers = [c for c in articles.get(at, ()) if mass[c] and 2 * mass[c] >= mass[b]] if blocks[b][3] else []
        if len(peers) > 1 and sum(mass[c] for c in peers) >= HOLDS_MARKED * mass[at]:
            return peers
        enough = HOLDS_MARKED if blocks[b][3] else HOLDS
        if not mass[b] or mass[b] < enough * mass[at] or sizes[b] < 2 and not blocks[b][3]:
            break  # a container of one line is a paragraph
        at = b
    return [at]


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The page's main text: the region's lines in page order, joined by one space; empty for a null or empty page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._cut()
    lines, blocks = parser.lines, parser.blocks
    if not lines:
        return ""
    above = clusters(lines, sigma, share).tolist()
    weight = [0] * len(blocks)
    for (text, _, b), a in zip(lines, above, strict=True):
        weight[b] += len(text) * a
    total = _upward(weight, blocks)
    out, spared = _is_out(blocks, set()), set()
    if sum(w for w, o in zip(weight, out, strict=True) if not o) < LEFT * total[0]:
        spared = {b for b in range(1, len(blocks)) if blocks[b][2] == 2 and total[b] > total[0] / 2}
        out = _is_out(blocks, spared)
    live, sizes = [0 if o else w for w, o in zip(weight, out, strict=True)], [0] * len(blocks)
    for _, _, b in lines:
        sizes[b] += not out[b]
    mass, sizes = _upward(live, blocks), _upward(sizes, blocks)
    chosen = region(blocks, mass, sizes)
    if not mass[chosen[0]]:
        return ""
    # the block just under the region that each block lies in; 0 outside of it
    under = [0] * len(blocks)
    for b in range(1, len(blocks)):
        under[b] = b if blocks[b][0] in chosen else under[blocks[b][0]]
    inside = [(b in chosen or under[b] > 0) and not out[b] for _, _, b in lines]
    hits = [i for i, (a, k) in enumerate(zip(above, inside, strict=True)) if a and k]
    whole = blocks[chosen[0]][3]

    def kept(i: int) -> bool:
        top = under[lines[i][2]]
        return inside[i] and (whole or hits[0] <= i <= hits[-1] or not top or mass[top] > 0 or blocks[top][1] not in CONTAINERS | {"ul", "ol"})

    return " ".join(text for i, (text, _, _) in enumerate(lines) if kept(i))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Marked sections of unknown kinds and comments without an end are no text; what else is malformed is read as the standard
    library reads it. A null or empty html gives an empty text with 0 characters; null ids and urls stay; repeated rows come back each, in
    no order; an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def make():
        def work(cols: dict) -> dict:
            texts = [main_text(h) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_arrow(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
