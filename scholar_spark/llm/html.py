"""Operator 3: main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends events; they are gathered into lines (blocks of text) with the number
of tags and of link characters in each, and the element each line stands in. Text-to-tag ratios along the
page are smoothed with a Gaussian and parted into content and the rest by a threshold from two clusters.
The regions are the articles that hold the lines of the content cluster, or the smallest element that holds
nearly all of them; inside a region every line counts, short ones too, except those in parts that are marked
as something else (menus, notices, adverts, comments ...). No part is marked if the article stands in it, and a
name of a marking word and a strange one (``social-science``) marks only what lies outside the content cluster.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import arrow_map

#: Fixed values of the HTML standard: elements that begin and end a block, and elements without an end.
BLOCKS = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
    tbody td tfoot th thead tr ul head""".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never an article's; those that are no blocks don't part the block they stand in.
SKIPPED = set(
    """head title script style noscript template nav menu aside button select option textarea iframe object svg annotation
    annotation-xml canvas audio video dialog search""".split()
)
#: Elements that may be a region by themselves.
REGIONS = set("body html article main section div td center form".split())
#: Words of class, id and role names for parts outside the article, wherever they stand in a name.
MARKS = set(
    """ad ads adsense adbox adslot adsbygoogle advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos
    promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets masthead topbar footer cookie
    cookies consent gdpr popup modal newsletter subscribe signup login share sharing sharebar social related recommend recommended
    recommendations comment comments commentlist disqus replies respond pagination pager contentinfo complementary paywall teaser
    toolbar searchbox searchform""".split()
)
#: Words that mark a part too, unless the element has a name for content.
WEAK = set(
    """side rail header foot bottom notice notices alert overlay more popular trending reply discussion tag tags toc hidden skip
    print copyright legal disclaimer search""".split()
)
CONTENT = set("content main article body entry post story text page".split())
#: Words that may stand beside a marking word in a name without changing what it says.
BESIDES = set(
    """a an and the in of for to by on top left right main site page primary secondary first last inner outer upper lower big small large
    list lists item items link links box boxes button buttons btn bar bars wrap wrapper container content contents section sections area areas
    block blocks slot slots unit units row rows col column columns panel panels group groups icon icons media network networks post
    posts article articles story stories text title titles label header heading head body bottom foot footer form forms field input thread
    count counter meta info law message msg notice notices alert policy settings mobile desktop global local sub super full wide mini sticky
    fixed floating float inline module component view region zone placement image img logo mid mpu leaderboard skyscraper square rail
    tools tool card cards feed grid html template v1 v2 up us this author authors user users reader readers wp js new old""".split()
)
#: Words that begin the names of an article that is none, and first words of names that tell how a page looks.
OTHERS = set("ad ads advert advertisement comment comments promo promoted related reply replies sponsored teaser".split())
LOOKS = set("has no with without is js not".split())
WORDS = re.compile(r"[a-z0-9]+").findall
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Headings, which belong to the region that follows them.
HEADINGS = {"h1", "h2"}
#: Elements that a new block of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 1.0
#: An element is the region by itself, or an article another region, with this share of the content cluster or of the best article.
ALONE, NEARLY, BESIDE = 0.3, 0.9, 0.2
#: Characters of a doubtful part that count as text of the article.
READS = 50


def marked(tag: str, attrs: list, headed: bool) -> int:
    """Whether names mark an element as a part outside the article: 2 surely, 1 if the content cluster doesn't hold it.

    ``headed``: the element stands in an article or main.
    """
    if tag in ("header", "footer"):
        return 2 * (tag == "footer" or not headed)
    if tag in ("main", "body", "html", "h1"):
        return 0
    said = dict(attrs)
    names = [WORDS(n.lower()) for k in ("class", "id", "role") for n in (said.get(k) or "").split()]
    names = [n for n in names if n and n[0] not in LOOKS]
    if tag == "article":
        return 2 * any(n[0] in OTHERS for n in names)
    marks = MARKS if any(w in CONTENT for n in names for w in n) else MARKS | WEAK
    return max((_says(n, marks) for n in names), default=0)


def _says(name: list[str], marks: set[str]) -> int:
    """2 for a name of marking words alone or beside plain ones, 1 with a strange word, 0 without a marking word."""
    if marks.isdisjoint(name):
        return 0
    return 1 + all(w in marks or w in MARKS or w in BESIDES or w.isdigit() for w in name)


def hidden(attrs: list) -> bool:
    said = dict(attrs)
    return "hidden" in said or bool(HIDDEN.search(said.get("style") or ""))


class Node:
    """An element that begins blocks, or one inside a block whose text goes (``inline``); its lines are start to end.

    ``skipped``: its text is not read. ``marked``: its text goes unless the article turns out to stand in it, or,
    of doubtful names (1), unless it is of the content cluster.
    """

    __slots__ = ("tag", "parent", "skipped", "marked", "inline", "headed", "start", "end")

    def __init__(self, tag, parent, skipped, marked, inline, start):
        self.tag, self.parent, self.skipped, self.marked, self.inline = tag, parent, skipped, marked, inline
        self.headed = parent is not None and parent.headed or tag in ("article", "main")
        self.start, self.end = start, None


class Lines(HTMLParser):
    """Gathers (text, tags, link characters, node) for each block, and the elements, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("html", None, False, 0, False, 0)
        self.nodes = [self.node]
        self.done: list[tuple[str, int, int, Node]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            home = self.node
            while home.inline:
                home = home.parent
            self.done.append((text, self.tags, self.linked, home))
        self.parts, self.tags, self.linked = [], 0, 0

    def finish(self):
        self.close()
        self.flush()
        self._leave(None)

    def _enter(self, tag, skipped, marked, inline):
        self.node = Node(tag, self.node, skipped or self.node.skipped, marked, inline, len(self.done))
        self.nodes.append(self.node)

    def _leave(self, outer):
        while self.node is not outer:
            self.node.end = len(self.done)
            self.node = self.node.parent

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self.flush()
            if tag == "hr":
                return
            self._imply(tag)
            if tag in ("html", "body") and self.node.tag == tag:
                return
            gone = hidden(attrs) or dict(attrs).get("aria-hidden") == "true"
            self._enter(tag, tag in SKIPPED or gone, 2 if tag == "form" else marked(tag, attrs, self.node.headed), False)
        elif tag == "br":
            self.parts.append(" ")
        elif tag in VOID:
            return
        elif tag in SKIPPED or self.node.inline and tag == self.node.tag or hidden(attrs) or tag == "label" and "for" in dict(attrs):
            self._enter(tag, True, 0, True)
        elif tag in ("ins", "span") and attrs and any(w in OTHERS or w == "adsbygoogle" for w in WORDS((dict(attrs).get("class") or "").lower())[:1]):
            self._enter(tag, True, 0, True)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in SKIPPED or tag in BLOCKS) and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def _imply(self, tag):
        """End what the new block ends by the rules of HTML: a paragraph or the head by any block, an item by the next."""
        closes = CLOSES.get(tag, set()) | {"p", "head", "title"}
        if self.node.tag in HEADINGS and tag != "li":
            return
        while self.node.tag in closes and self.node.parent is not None:
            self._leave(self.node.parent)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        at = self.node
        if tag in BLOCKS:
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None and at.parent is not None:
                self.flush()
                self._leave(at.parent)
            elif tag == "p":
                self.flush()
            return
        while at.inline and at.tag != tag:
            at = at.parent
        if at.inline:
            self._leave(at.parent)

    def handle_data(self, data):
        if not self.node.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing along the page; weights are renewed at the ends."""
    r = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(max(-r, -i), min(r, len(values) - 1 - i) + 1):
            total += kernel[k + r] * values[i + k]
            weight += kernel[k + r]
        out.append(total / weight)
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """Midway between the centres of two clusters of ``values``."""
    low, high = min(values), max(values)
    for _ in range(rounds):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            break
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in page order, one on a line; '' for null or empty pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    _clear(parser)
    seeds = _seeds(parser)
    if _doubtful(parser, seeds):  # with what went, the page is another one
        seeds = _seeds(parser)
    if not seeds:
        return ""
    mass = list(accumulate((seeds.get(id(x), 0) for x in parser.done), initial=0))
    heads = list(accumulate((not x[3].skipped and x[3].tag in HEADINGS for x in parser.done), initial=0))
    regions = _regions([n for n in parser.nodes if not n.skipped], mass, heads)
    kept = []
    for i, (text, tags, linked, node) in enumerate(parser.done):
        region = next((r for r in regions if r.start <= i < r.end), None)
        if region and not node.skipped and (region.tag in ("article", "main") or node.tag in HEADINGS or 2 * linked <= len(text)):
            kept.append((i, text))
    title = _title(parser.done, regions[0]) if regions[0].tag in ("article", "main") else None
    return "\n".join(([title] if title else []) + [text for _, text in kept])


def _seeds(parser: Lines) -> dict[int, int]:
    """id of each line of the content cluster -> its characters outside links."""
    lines = [x for x in parser.done if not x[3].skipped]
    if not lines:
        return {}
    level = smoothed([max(0, len(text) - linked) / (1 + tags) for text, tags, linked, _ in lines])
    cut = threshold(level)
    return {id(x): max(1, len(x[0]) - x[2]) for x, v in zip(lines, level) if v >= cut}


def _doubtful(parser: Lines, seeds: dict[int, int]) -> bool:
    """Skip the parts of doubtful names, but for those that read like text (``READS`` characters outside links,
    three times as many as in links) and lie in an article or half in the content cluster; whether there were any."""
    doubtful = [n for n in parser.nodes if n.marked == 1 and not n.skipped]
    if not doubtful:
        return False
    size = list(accumulate((len(x[0]) - x[2] for x in parser.done), initial=0))
    mass = list(accumulate((seeds.get(id(x), 0) for x in parser.done), initial=0))
    whole = list(accumulate((len(x[0]) for x in parser.done), initial=0))
    text = lambda n: (size[n.end] - size[n.start], whole[n.end] - whole[n.start])
    reads = lambda plain, every: plain >= READS and 4 * plain >= 3 * every
    gone = [n for n in doubtful if not (reads(*text(n)) and (n.headed or 2 * (mass[n.end] - mass[n.start]) >= text(n)[0]))]
    for node in gone:
        node.skipped = True
    for node in parser.nodes if gone else ():
        node.skipped = node.skipped or node.parent is not None and node.parent.skipped
    return bool(gone)


def _clear(parser: Lines) -> None:
    """Settle which marked elements are parts outside the article: not those around main, nor a form around the article."""
    size = list(accumulate((len(x[0]) - x[2] for x in parser.done), initial=0))
    plain = list(accumulate((x[3].tag == "p" for x in parser.done), initial=0))
    mains = [n for n in parser.nodes if n.tag == "main" and n.start < n.end and not n.skipped]
    articles = mains + [n for n in parser.nodes if n.tag in ("article", "h1") and n.start < n.end and not n.skipped]
    around = {id(n) for x in mains for n in _outer(x)}
    holding = {id(n) for x in articles for n in _outer(x)}
    for node in parser.nodes:  # outer elements come first
        if node.marked:
            most = 2 * (size[node.end] - size[node.start]) >= size[-1] and plain[node.end] > plain[node.start]
            if node.tag == "form":
                node.marked = 0 if most or id(node) in holding else 2
            elif id(node) in around or most and id(node) in holding:
                node.marked = 0
        node.skipped = node.skipped or node.marked == 2 or node.parent is not None and node.parent.skipped


def _outer(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _regions(nodes: list[Node], mass: list[int], heads: list[int]) -> list[Node]:
    """The articles, or the smallest element, with nearly all of the content cluster; in page order."""

    def own(node):
        return mass[node.end] - mass[node.start]

    articles, inside = [], 0
    for node in nodes:
        if node.tag == "article" and node.start >= inside and own(node):
            articles.append(node)
            inside = node.end
    best = max(articles, key=own, default=None)
    if best is not None and own(best) >= ALONE * mass[-1]:
        return [n for n in articles if own(n) >= BESIDE * own(best)]
    best = max((n for n in nodes if n.tag == "main" and own(n)), key=own, default=best)
    if best is not None and own(best) >= ALONE * mass[-1]:
        return [best]
    root = nodes[0]
    for node in nodes[1:]:  # those with nearly all of the cluster lie in one another
        if node.tag in REGIONS and own(node) >= NEARLY * mass[-1]:
            if heads[node.end] - heads[node.start] < heads[root.end] - heads[root.start]:
                break
            root = node
    return [root]


def _title(lines: list, region: Node) -> str | None:
    """The title that stands before a region without one."""
    if any(node.tag == "h1" for *_, node in lines[region.start : region.end]):
        return None
    return next((text for text, _, linked, node in reversed(lines[: region.start]) if node.tag == "h1" and not node.skipped and 2 * linked <= len(text)), None)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text for each row of ``pages``.

    A null or empty html, or a page without an article, gives text ''. Repeated rows and null keys give a
    row each; other columns are not read. Each page is parsed by itself: no shuffle, memory of one page.
    """

    def make():
        def each(row):
            text = main_text(row["html"])
            yield row["page_id"], row["url"], text, len(text)

        return each

    return arrow_map(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint")
