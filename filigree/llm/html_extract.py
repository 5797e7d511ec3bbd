"""Main text of a page by tree scoring.

The html is read into a tree with HTML's own rules for closing (a p ends at the next block, a li at the next li, ...), so
unclosed and crossed tags do no harm. Scripts, styles, comments, forms, buttons, navigation, footers, asides, dialogs, hidden
elements and headers outside an article are left out, and so are elements whose class, id or role says that they are such.

Names. A name is read word by word (at hyphens, underscores and capitals), and its last word counts, as the most specific:
post-comments are comments, a section-header or no-sidebar is nothing of the kind. General words at the end (box, list, item, ...)
pass the question on to the word before. An element that is named so stays all the same if it holds the page's article or main
element, or its h1 and a third of its text: then it is the frame of the page. Names that have such a word elsewhere halve a
score.

Scoring. Each paragraph (a block that has text of its own) passes points to its ancestors: 1, and 1 for each 100
characters (3 at most), and 1 for each comma, discounted by its link density; its parent gets all of them, the
grandparent one half, the next a third, and so on up to REACH of them. A container's score is then discounted by its own link
density; article and main elements start with a bonus. The best container is kept with every block below it; if an article
or main element holds it, that is kept. Of its siblings those are kept, unless they are mostly links, that score at least
a fifth of it, that are the same kind of element (a section beside a section), that hold the h1, or that are paragraphs of some length. A page's only h1, where it stands before
what is kept, is kept, too.

Text. A block's text has its character references decoded and its white space turned into one space, trimmed; blocks are
joined in page order by one newline. Lists of links in what is kept stay.

Reading and scoring take time in proportion to the page, however its tags are nested, left open or quoted.

Defined cases: a null or empty html gives the empty text; text outside any element is a paragraph of the body; a page without any
paragraph gives the empty text; if names leave nothing, they are not heeded; a tag that never ends is text until the end of the page; other
columns are ignored, rows are kept as they are, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select object canvas".split())
SKIP = RAW | frozenset("head nav header footer aside form button dialog menu audio video".split())
BLOCK = frozenset(
    "address article blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption search".split()
)
#: A start tag of the key closes an open element of the values, up to the nearest of the barrier.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BARRIER = ("table", "ul", "ol", "dl", "menu")
#: Words of names for what is not the article: reader comments, and all others.
DISCUSSION = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification footer masthead header topbar navbar nav navigation menu submenu sidebar rail aside widget widgets related recommended recommendations share sharing social sponsor sponsored sponsors promo promos promotion popup modal overlay newsletter subscribe subscription signup login pager pagination rss toolbar contentinfo complementary search alert copyright hidden".split()
)
#: Words that say nothing by themselves; the word before counts.
GENERAL = frozenset(
    "area bar block blocks body box buttons col column container content contents entry form group holder icons inner item items label left right link links list module outer panel pane post posts row section section slot stories story text thread title top bottom unit wrap wrapper zone".split()
)
#: Words before, that turn a name's meaning: no-sidebar, has-sidebar, overflow-hidden.
TURNED = frozenset("no not non has with without overflow is backface".split())
#: A header of these is part of the article.
OWN_HEADER = frozenset("article post entry section story page content chapter recipe table card".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADING | frozenset("p ul ol dl table pre blockquote figure details".split())
#: How many ancestors a paragraph passes points to.
REACH = 12
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "name", "parent", "link", "apart", "out", "kind", "named", "points", "chars", "links", "children", "article", "h1", "kept")

    def __init__(self, tag: str, parent: Node | None, link: bool) -> None:
        self.tag, self.parent, self.link, self.name = tag, parent, link, ""
        self.apart = False  # inside a line, but perhaps not of the text
        self.out = False  # left out whatever its names
        self.kind = ""  # what its names say: "", "other" or "discussion"
        self.named = self.article = self.h1 = self.kept = False
        self.points, self.chars, self.links = 0.0, 0, 0
        self.children: list[Node] = []


class Block:
    """A run of text with no block boundary inside."""

    __slots__ = ("owner", "parts", "linked", "text")

    def __init__(self, owner: Node) -> None:
        self.owner, self.parts, self.linked, self.text = owner, [], 0, ""


def kind_of(name: str) -> tuple[str, bool]:
    """Of one class, id or role: "discussion", "other" or "", and whether it has such a word anywhere."""
    words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    some = any(w in OTHERS or w in DISCUSSION for w in words)
    if not some:
        return "", False
    k = len(words) - 1
    while k > 0 and words[k] in GENERAL:
        k -= 1
    before = words[k - 1] if k else ""
    if before in TURNED or (words[k] == "header" and before in OWN_HEADER):
        return "", True
    return "discussion" if words[k] in DISCUSSION else "other" if words[k] in OTHERS else "", True


def _read_names(node: Node, attributes: str) -> None:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "style":
            node.out |= bool(_UNSEEN.search(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            node.out = True
        elif name in ("class", "id", "role"):
            node.name += value if name == "class" else ""
            for one in value.split():
                kind, some = kind_of(one)
                node.named |= some
                if kind and (node.kind != "discussion"):
                    node.kind = kind


class _Tags:
    """Tags of a page from left to right. Quotes that lead to no end of a tag are remembered, so that none is followed twice."""

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()

    def end(self, at: int) -> int:
        """The place of the '>' that ends the tag whose attributes start at `at`, or -1."""
        page, quotes = self.page, []
        k = at
        while True:
            m = _STOP.search(page, k)
            if m is None:
                k = -1
            elif m[0] == ">":
                return m.start()
            elif m.start() in self.dead:
                k = -1
            else:
                quotes.append(m.start())
                k = page.find(m[0], m.end()) + 1 or -1
            if k < 0:
                self.dead.update(quotes)
                return page.find(">", at)


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """All elements, parents first, and all blocks, in page order."""
    root = Node("#root", None, False)
    nodes, stack, blocks = [root], [root], []
    opened: dict[str, list[int]] = defaultdict(list)  # of each tag the places in the stack
    in_blocks, current = [0], None
    tags, at, end = _Tags(page), 0, len(page)

    def cut(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()
            if in_blocks[-1] == len(stack):
                in_blocks.pop()

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if stack[-1].apart:
            blocks.append(Block(stack[-1]))
            blocks[-1].parts.append(piece)
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(stack[in_blocks[-1]])
            blocks.append(current)
        current.parts.append(piece)
        if stack[-1].link:
            current.linked += len(piece.strip())

    opened["#root"].append(0)
    while at < end:
        k = page.find("<", at)
        if k < 0:
            text(page[at:])
            break
        text(page[at:k])
        at = k
        if page.startswith("<!--", at):
            at = page.find("-->", at) + 3 if page.find("-->", at) >= 0 else end
            continue
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            text(html.escape(page[at + 9 : stop if stop >= 0 else end], quote=False))
            at = stop + 3 if stop >= 0 else end
            continue
        if page[at : at + 2] in ("<!", "<?"):
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        m = _OPEN.match(page, at)
        stop = tags.end(m.end()) if m else at
        if m is None:
            text("<")
            at += 1
            continue
        if stop < 0:
            text(page[at:])
            break
        closing, tag, attributes = m[1], m[2].lower(), page[m.end() : stop]
        at = stop + 1
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            current = None
        if closing:  # an end tag closes its element and what is open inside; without one it says nothing
            if opened[tag] and (tag in BLOCK or in_blocks[-1] < opened[tag][-1]) and opened[tag][-1] > 0:
                cut(opened[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and stack[in_blocks[-1]].tag == "p":  # an open p ends here, with what is inside
            cut(in_blocks[-1])
        if tag in CLOSES:
            barrier = max((opened[b][-1] for b in BARRIER if opened[b]), default=0)
            for c in CLOSES[tag]:
                while opened[c] and opened[c][-1] > barrier:
                    cut(opened[c][-1])
        if tag == "body":
            cut(1)
        parent = stack[-1]
        node = Node(tag, parent, parent.link or tag == "a")
        node.article = parent.article or tag in ("article", "main")
        node.out = tag in SKIP and not (tag == "header" and node.article)
        if attributes and not node.out and tag not in ("body", "html", "main"):
            _read_names(node, attributes)
        node.apart = tag not in BLOCK and (parent.apart or node.out or node.kind != "")
        parent.children.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not attributes.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span", "em", "strong"):
            opened[tag].append(len(stack))
            if tag in BLOCK:
                in_blocks.append(len(stack))
            stack.append(node)
    for b in blocks:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
    return nodes, [b for b in blocks if b.text]


def _leave_out(nodes: list[Node], blocks: list[Block], by_name: bool) -> None:
    """Sets out of all elements that are left out by what they are, what they are called, or where they are."""
    chars: dict[int, int] = defaultdict(int)
    holds, titled, gone = set(), set(), set()  # elements with an article or main of its own, or an h1, inside; those left out for sure
    for node in nodes[1:]:
        if id(node.parent) in gone or (node.out and node.tag != "form"):
            gone.add(id(node))
    for b in blocks:
        chars[id(b.owner)] += len(b.text)
    total = sum(len(b.text) for b in blocks if id(b.owner) not in gone)
    for node in reversed(nodes[1:]):
        up = id(node.parent)
        chars[up] += chars[id(node)]
        if id(node) in holds or (node.tag in ("article", "main") and not node.kind):
            holds.add(up)
        if id(node) in titled or node.tag == "h1":
            titled.add(up)
    for node in nodes[1:]:
        frame = (id(node) in holds and node.kind != "discussion") or (id(node) in titled and 3 * chars[id(node)] >= total)
        node.out = node.parent.out or (node.out and not (node.tag == "form" and frame)) or (by_name and node.kind != "" and not frame)


def _density(node: Node) -> float:
    return min(1.0, node.links / node.chars) if node.chars else 0.0


def _value(node: Node) -> float:
    return (node.points + 25 * (node.tag in ("article", "main")) * (node.chars > 0)) * (1 - _density(node)) * (0.5 if node.named else 1)


def extract(page: str | None) -> str:
    if not page:
        return ""
    for by_name in (True, False):
        nodes, blocks = parse(page)
        _leave_out(nodes, blocks, by_name)
        blocks = [b for b in blocks if not b.owner.out]
        if blocks:
            return _main_text(nodes, blocks)
        if not any(n.kind for n in nodes):
            break
    return ""


def _main_text(nodes: list[Node], blocks: list[Block]) -> str:
    scored: dict[int, Node] = {}
    for b in blocks:
        n = len(b.text)
        points = (1 + min(3, n // 100) + b.text.count(",")) * (1 - min(1.0, b.linked / n))
        node, level = b.owner, 0
        node.chars += n
        node.links += b.linked
        node.h1 |= node.tag == "h1"
        for _ in range(REACH):
            if node is None:
                break
            if level or node.tag not in ("p", "li", "td", "pre", "figcaption", *HEADING):
                level += 1
                node.points += points / level
                scored[id(node)] = node
            node = node.parent
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links
        node.parent.h1 |= node.h1
    if not scored:
        scored = {id(nodes[0]): nodes[0]}
    best = max(scored.values(), key=_value)
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    best = whole or best
    best.kept, least = True, _value(best) / 5
    if best.parent is not None and best.tag not in ("body", "html", "#root"):
        for other in best.parent.children:
            if other.out or not other.chars or _density(other) >= 0.5:
                continue
            alike = other.tag == best.tag and other.tag not in ("article", "main") and (other.tag == "section" or (other.name != "" and other.name == best.name))
            textual = other.tag in TEXTUAL and (other.chars > 80 or other.tag == "h1") and _density(other) < 0.25
            other.kept |= alike or textual or other.h1 or (id(other) in scored and _value(other) >= least)
    for node in nodes[1:]:
        node.kept |= node.parent.kept
    heads = [b for b in blocks if b.owner.tag == "h1"]
    out, begun = [], False
    for b in blocks:
        begun |= b.owner.kept
        if b.owner.kept or (len(heads) == 1 and b is heads[0] and not begun):
            out.append(b.text)
    return "\n".join(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, "html"):
            texts = pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        _texts, "page_id long, url string, text string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
