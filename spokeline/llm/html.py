"""Operator 7: main text of web pages by tree scoring.

A page is cut into tags and text, and a tree of its containers is kept while reading. Each block of text (paragraph,
heading, list entry, ...) is worth points for its length and its commas, discounted by the share of its letters that stand in
links; it passes them to its container whole, and each container passes half of what it gets on to its own, up to the top. Containers whose name, class, id
or role says menu, header, footer, sidebar, notice, advert, form or comments are left out, but names that speak of a layout or state (`has-sidebar`) do not count, html and body are never left out,
main by name only as comments, article as these or by a whole name of its class (`related`, not `has-related`). A link counts if it has a target and is closed before the next one. The container with the
most points is the article; siblings with a fair share of its points are kept with it. A page is read once from
left to right, and its tree is gone over once in each direction, so the time grows with the page's length whatever is in it.

Defined results: null and empty pages, and pages without a block outside left-out containers, give an empty text. Unclosed and
crossed tags are closed as browsers do for paragraphs and list entries, else at their container's end. A quote in a tag that is never
closed is a sign like others, and a tag that is never closed is text, as all after it is. Ties go to the outer container
that comes first. Repeated rows are read each; a null page_id or url is kept; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption address summary".split())
CONTAINERS = frozenset("html body main article section div ul ol dl table tbody thead tfoot tr figure details center hgroup search".split())
LEFT_OUT = frozenset("head nav header footer aside form button menu dialog fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITS_KIND = frozenset("p li dt dd td th".split())
# Words of class, id and role that mark what is not the article.
NOT_MAIN = re.compile(
    r"ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside"
    r"|widget|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|cookie\w*|consent|notice|notices|alert|popup|modal|overlay|disclaimer|copyright"
    r"|comments?|replies|disqus|form|search|pagination|pager|tags|complementary|contentinfo|skip",
    re.IGNORECASE,
)
COMMENT = re.compile(r"(?:^|\s)(?:comments?|reply|replies)(?:[_-]\S*)?(?:\s|$)", re.IGNORECASE)
# Words beside those in a name that say how a page is laid out or what state it is in, not what the element is.
STATE = frozenset("no not non has have with without is are hide hides hidden show shows off on enable enabled disable disabled ready active inactive open opened closed loaded visible free less allowed accepted".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text|hentry)(?:$|[\s_-])", re.IGNORECASE)

#: A whole tag; no part of it is read twice. What it does not take is scanned by hand.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
NAMING = frozenset(("class", "id", "role", "itemprop"))
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
LINK_TAG = re.compile(r"<(/?)a(?=[\s>/])", re.IGNORECASE)
#: What a container passes on of the points it gets.
PASSED_ON = 0.5
#: A sibling of the best container with this share of its points is kept.
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("blocks", "bonus", "children", "name", "out", "parent", "points")

    def __init__(self, name: str, parent: Node | None, out: bool, bonus: float = 0.0):
        self.name, self.parent, self.out, self.bonus = name, parent, out, bonus
        self.points, self.blocks, self.children = 0.0, [], []


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by their small-letter names; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


@lru_cache(maxsize=10_000)
def marks_other(names: str) -> bool:
    """Whether a name of a class list says that this is not the article: one of its words does, and none speaks of a state."""
    for name in names.split():
        words = re.split(r"[_-]+", name)
        if any(map(NOT_MAIN.fullmatch, words)) and not any(w.lower() in STATE for w in words):
            return True
    return False


def closed_links(html: str) -> set[int]:
    """Where links begin that are closed before the next one begins."""
    out, last = set(), -1
    for m in LINK_TAG.finditer(html):
        if not m[1]:
            last = m.start()
        elif last >= 0:
            out.add(last)
            last = -1
    return out


def points(text: str, linked: int) -> float:
    """One point, one for each comma, one for each hundred letters (three at most), less what stands in links."""
    return (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - linked / max(1, len(text)))


class Page:
    """One pass over a page's tags: the containers, and the blocks of text in them."""

    def __init__(self, html: str):
        self.links = closed_links(html)
        self.link_depth = 0  # open elements when the open link began
        self.top = self.at = Node("", None, False)
        self.nodes = [self.top]  # containers before what they contain
        self.open: list[tuple[str, Node]] = []  # open elements that matter, with the container they stand in
        self.places: dict[str, list[int]] = {}  # where elements of a name stand among the open ones
        self.walls: list[int] = []  # where containers do
        self.kind, self.said, self.linked, self.in_link = "", [], 0, False
        self.never: set[str] = set()  # ends that do not come any more
        self.read(html)
        self.end_block()

    def text(self, raw: str) -> None:
        if raw and not self.at.out:
            self.said.append(raw)
            if self.in_link:
                self.linked += len(raw.strip())

    def end_block(self) -> None:
        if self.said:
            text = " ".join(unescape("".join(self.said)).split())
            if text:
                self.at.blocks.append((text, self.kind, min(self.linked, len(text))))
                self.at.children.append(None)  # a place in page order
            self.said = []
        self.kind, self.linked = "", 0

    def close(self, name: str) -> None:
        """Close the innermost open element of that name, and all within it."""
        if self.places.get(name):
            k = self.places[name][-1]
            self.at = self.open[k][1]
            while len(self.open) > k:
                inner = self.open.pop()[0]
                self.places[inner].pop()
                if self.walls and self.walls[-1] == len(self.open):
                    self.walls.pop()
            if self.in_link and self.link_depth > k:
                self.in_link = False  # a link ends with what it stands in

    def start(self, name: str, attributes: str) -> None:
        self.end_block()
        # paragraphs and entries close one of their kind that is open in the same container
        if name in CLOSES_ITS_KIND and self.places.get(name) and self.places[name][-1] > (self.walls[-1] if self.walls else -1):
            self.close(name)
        given = attributes_of(attributes) if attributes else {}
        names = " ".join(v for k, v in given.items() if k in NAMING)
        out = self.at.out or name in LEFT_OUT or (name not in ("html", "body") and self.says_other(name, names, given))
        self.places.setdefault(name, []).append(len(self.open))
        if name not in BLOCKS:
            self.walls.append(len(self.open))
        self.open.append((name, self.at))
        if name in BLOCKS and out == self.at.out:
            self.kind = name
        else:
            node = Node(name, self.at, out, 25.0 * (name in ("article", "main")) + 10.0 * bool(names and MAIN.search(names)))
            self.nodes.append(node)
            self.at.children.append(node)
            self.at = node

    def says_other(self, name: str, names: str, given: dict[str, str]) -> bool:
        """Whether the attributes of an element leave it out: hidden ones; by name, main only as comments, article as these or by a whole name."""
        if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or NO_DISPLAY.search(given.get("style", "")):
            return True
        if name in ("main", "article"):
            return bool(COMMENT.search(names)) or (name == "article" and any(map(NOT_MAIN.fullmatch, names.split())))
        return bool(names) and marks_other(names)

    @staticmethod
    def tag(html: str, at: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag at a place: it ends at the first > outside quotes; None if nothing ends it."""
        m = TAG.match(html, at)
        if m:
            return m[1], m[2], m[3], m.end()
        m = TAG_NAME.match(html, at)
        pos = m.end()
        while q := QUOTE_OR_END.search(html, pos):
            if q[0] == ">":
                return m[1], m[2], html[m.end() : q.start()], q.end()
            closed = html.find(q[0], q.end())
            pos = closed + 1 if closed >= 0 else q.end()
        return None

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            self.text(html[at:lt])
            sign = html[lt + 1 : lt + 2]
            if not sign:
                self.text(html[lt:])
                return
            if sign in "!?":
                mark, close = ("<!--", "-->") if html.startswith("<!--", lt) else ("<![CDATA[", "]]>") if html.startswith("<![CDATA[", lt) else (sign, ">")
                stop = -1 if close in self.never else html.find(close, lt + len(mark) if len(mark) > 1 else lt)
                if stop < 0:
                    self.never.add(close)
                if stop < 0 and mark != "<!--":
                    stop = html.find(close := ">", lt)
                    if stop < 0:
                        self.text(html[lt:])
                        return
                at = stop + len(close) if stop >= 0 else end
                continue
            if not TAG_NAME.match(html, lt):
                self.text("<")
                at = lt + 1
                continue
            got = self.tag(html, lt)
            if got is None:
                self.text(html[lt:])
                return
            slash, name, attributes, at = got
            at = self.element(html, slash, name.lower(), attributes, at, lt)

    def element(self, html: str, slash: str, name: str, attributes: str, at: int, begin: int) -> int:
        """What a tag (from begin to at) does; returns where to read on."""
        alone = attributes.endswith("/")
        if slash:
            if name == "a":
                self.in_link = False
            elif name in BLOCKS or name in CONTAINERS or name in LEFT_OUT:
                self.end_block()
                self.close(name)
        elif name in RAW:
            if not alone and name not in self.never:
                stop = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(html, at)
                if stop:
                    return stop.end()
                self.never.add(name)
            if not alone and name in ("script", "style"):
                return len(html)
        elif name == "a":
            self.in_link, self.link_depth = begin in self.links and "href" in attributes_of(attributes), len(self.open)
        elif name in ("br", "hr"):
            self.said.append(" ")
            if name == "hr":
                self.end_block()
        elif name not in VOID and not alone and (name in BLOCKS or name in CONTAINERS or name in LEFT_OUT):
            self.start(name, attributes)
        return at

    # -- scores --------------------------------------------------------------------------------
    def score(self) -> None:
        """Points of all containers, from the innermost ones up."""
        for node in reversed(self.nodes):
            if not node.out:
                node.points += sum(points(text, linked) for text, _, linked in node.blocks)
                if node.parent is not None:
                    node.parent.points += PASSED_ON * node.points

    def all_blocks(self, node: Node) -> list[str]:
        """Blocks under a node in page order, without left-out containers; lists of links go too."""
        out: list[str] = []
        todo: list = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif not x.out:
                blocks = iter(x.blocks)
                todo += reversed([next(blocks) if c is None else c for c in x.children if c is None or not c.out])
        return out

    def main(self) -> list[str]:
        self.score()
        best, most, todo = None, 0.0, [self.top]
        while todo:
            node = todo.pop()
            if node.out:
                continue
            got = node.points + (node.bonus if node.points > 0 else 0)
            if got > most:
                best, most = node, got
            todo += [c for c in reversed(node.children) if c is not None]
        if best is None:
            return []
        if best.parent is None or best.name in ("article", "main", "body"):
            return self.all_blocks(best)
        out: list[str] = []
        blocks = iter(best.parent.blocks)
        for c in best.parent.children:
            if c is None:
                text, kind, linked = next(blocks)
                if kind in HEADINGS or (linked < 0.25 * len(text) and (len(text) > 80 or text[-1:] in ".!?…")):
                    out.append(text)
            elif c is best or (not c.out and c.points >= SIBLING_SHARE * best.points):
                out += self.all_blocks(c)
        return out


def main_text(html: str | None) -> str:
    return "\n".join(Page(html).main()) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def read(batches):
        for b in batches:
            text = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
