"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' words and links."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_with_tasks
from .common import query, table

ship_with_tasks(__name__)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKENS = re.compile(r"[a-z]+")

# Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template iframe object svg math canvas title textarea select button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that don't end a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_MENU_TAGS = frozenset("nav aside footer menu dialog".split())
_WEAK_TAGS = frozenset(("header", "form"))
_MAIN_TAGS = frozenset(("article", "main"))
# Words in class, id or role that mark readers' comments, and those that mark other matter round an article.
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
_ROUND_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies dialog footer header "
    "masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion related search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)

# Blocks labelled by hand: main text or not; words, link density; the same of the block before and after (0 words where there is none);
# and where it stands: 1 in an article, -1 in a menu, advert, comment or the like, 0 elsewhere.
LABELLED = """
main words links before_words before_links after_words after_links place
1 60 0.0 45 0.0 80 0.0 0
1 35 0.05 50 0.0 40 0.0 0
1 25 0.0 6 0.0 70 0.0 0
1 8 0.0 4 1.0 55 0.0 0
1 7 0.0 60 0.0 48 0.0 0
1 3 0.0 70 0.0 90 0.0 0
1 14 0.2 65 0.0 30 0.1 0
1 18 0.0 40 0.0 2 1.0 0
1 120 0.1 0 0.0 5 1.0 0
1 40 0.25 55 0.1 60 0.0 0
1 22 0.0 12 0.0 34 0.0 0
1 90 0.0 3 1.0 3 1.0 0
1 30 0.0 0 0.0 0 0.0 0
1 16 0.0 0 0.0 0 0.0 0
0 1 1.0 1 1.0 1 1.0 0
0 2 1.0 3 1.0 2 1.0 0
0 4 1.0 2 1.0 60 0.0 0
0 3 1.0 80 0.0 4 1.0 0
0 12 0.8 10 0.7 14 0.9 0
0 25 0.7 20 0.8 6 1.0 0
0 5 0.0 2 1.0 3 1.0 0
0 6 0.0 3 1.0 0 0.0 0
0 9 0.3 4 1.0 5 0.9 0
0 4 0.0 0 0.0 3 1.0 0
0 8 0.0 5 1.0 6 0.5 0
0 7 0.1 4 0.0 5 0.0 0
0 5 0.0 6 0.0 0 0.0 0
0 3 0.0 4 0.0 2 0.0 0
0 40 0.6 3 1.0 2 1.0 0
0 10 0.5 60 0.0 8 0.6 0
1 1 0.0 50 0.0 60 0.0 1
1 5 0.0 2 1.0 40 0.0 1
1 12 0.0 8 0.0 30 0.0 1
1 70 0.1 12 0.0 55 0.0 1
1 20 0.0 70 0.0 14 0.0 1
1 4 0.0 6 0.0 5 0.0 1
1 3 1.0 45 0.0 50 0.0 1
1 30 0.6 25 0.0 40 0.0 1
1 9 0.0 0 0.0 0 0.0 1
1 2 1.0 3 1.0 2 1.0 1
1 15 0.9 12 0.9 18 0.8 1
0 1 1.0 1 1.0 1 1.0 -1
0 60 0.0 70 0.0 65 0.0 -1
0 8 0.0 3 1.0 12 0.0 -1
0 15 0.0 80 0.0 0 0.0 -1
0 30 0.1 20 0.0 25 0.0 -1
0 5 0.0 60 0.0 70 0.0 -1
0 4 0.5 50 0.0 4 1.0 -1
0 100 0.0 0 0.0 30 0.0 -1
0 20 0.9 20 0.8 18 0.9 -1
"""


def labelled_rows() -> list[tuple[int, tuple[float, ...]]]:
    lines = [line.split() for line in LABELLED.strip().splitlines()[1:]]
    return [(int(label), tuple(map(float, rest))) for label, *rest in lines]


@dataclass
class Node:
    """A split of the tree, or a leaf with the share of main text."""

    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def train_tree(rows: list[tuple[int, tuple[float, ...]]], depth: int = 6) -> Node:
    """A classification tree by Gini impurity; limits lie halfway between neighbouring values."""
    ones = sum(label for label, _ in rows)
    node = Node(ones / len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return node

    def impurity(part: list[tuple[int, tuple[float, ...]]]) -> float:
        p = sum(label for label, _ in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0][1])):
        values = sorted({x[f] for _, x in rows})
        for a, b in zip(values, values[1:], strict=False):
            low = [r for r in rows if r[1][f] <= (a + b) / 2]
            high = [r for r in rows if r[1][f] > (a + b) / 2]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None or best[0] >= impurity(rows) - 1e-12:
        return node
    node.feature, node.limit = best[1], best[2]
    node.low, node.high = train_tree(best[3], depth - 1), train_tree(best[4], depth - 1)
    return node


_trees: list[Node] = []


def default_tree() -> Node:
    # Not a cached function: those are shipped by name, and workers may lack the package.
    if not _trees:
        _trees.append(train_tree(labelled_rows()))
    return _trees[0]


def is_main(tree: Node, features: tuple[float, ...]) -> bool:
    while tree.low is not None:
        tree = tree.low if features[tree.feature] <= tree.limit else tree.high
    return tree.share >= 0.5


@dataclass
class Box:
    """An open element: what its tag and names say about its content."""

    tag: str
    parent: Box | None
    main: bool = False
    round_: str = ""  # "", "weak" or "strong"
    holds_main: bool = False
    words: int = 0  # outside links and strong boxes
    most: bool = False
    _place: int | None = None

    def place(self) -> int:
        """-1 round an article, 1 in one, 0 elsewhere. Decided when the page has been read."""
        chain, box = [], self
        while box is not None and box._place is None:
            chain.append(box)
            box = box.parent
        above = box._place if box is not None else 0
        for box in reversed(chain):
            if above == -1 or box.round_ == "strong" or box.round_ == "weak" and not (box.holds_main or box.most) and above != 1:
                above = -1
            elif box.main:
                above = 1
            box._place = above
        return above


def _box(tag: str, attributes: str, parent: Box | None) -> Box:
    names = {w for m in _HINT.finditer(attributes) for w in _TOKENS.findall((m[2] or m[3] or m[4] or "").lower())} if attributes else frozenset()
    box = Box(tag, parent)
    if names & _COMMENT_WORDS or tag in _MENU_TAGS:
        box.round_ = "strong"
    elif tag not in ("html", "body", *_MAIN_TAGS) and names & _ROUND_WORDS:
        box.round_ = "strong" if parent is not None and _in_main(parent) else "weak"
    elif tag in _WEAK_TAGS:
        box.round_ = "strong" if tag == "form" and parent is not None and _in_main(parent) else "weak"
    elif tag in _MAIN_TAGS:
        box.main = True
        while parent is not None and not parent.holds_main:
            parent.holds_main = True
            parent = parent.parent
    return box


def _mark_most(boxes: list[Box], free: int) -> None:
    """Adds up the words of boxes, given in the page's order, and marks those that hold more than half of all.

    ``free`` are words outside every box; words in links or strong boxes don't count.
    """
    total = free
    for box in reversed(boxes):
        if box.round_ == "strong":
            continue
        if box.parent is not None:
            box.parent.words += box.words
        else:
            total += box.words
    # Words in a box that lies in a strong one never get past it.
    for box in boxes:
        box.most = 2 * box.words > total


def _in_main(box: Box | None) -> bool:
    while box is not None:
        if box.main:
            return True
        box = box.parent
    return False


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    box: Box | None = None


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """``(text, words, link density, place)`` of the text blocks of a page, in its order."""
    found: list[Block] = []
    boxes: list[Box] = []
    now, box, links, at = Block(), None, 0, 0

    def close() -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block()

    def add(text: str) -> None:
        if text:
            if not now.parts or now.box is None:
                now.box = box
            now.parts.append(text)
            if links:
                now.linked.append(text)

    while (token := _TOKEN.search(page, at)) is not None:
        add(page[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag, closing = token[2].lower(), bool(token[1])
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            add(" ")
        elif tag in _SILENT:
            if not closing and not token[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
        elif tag not in _INLINE:
            close()
            links = 0
            if tag in _VOID:
                continue
            if closing:
                over = box
                while over is not None and over.tag != tag:
                    over = over.parent
                box = over.parent if over is not None else box
            else:
                if box is not None and box.tag == "p":
                    box = box.parent
                if tag == "li":
                    over = box
                    while over is not None and over.tag not in ("li", "ul", "ol", "menu"):
                        over = over.parent
                    box = over.parent if over is not None and over.tag == "li" else box
                box = _box(tag, token[3], box)
                boxes.append(box)
    add(page[at:])
    close()
    out, free = [], 0
    for block in found:
        words = html.unescape("".join(block.parts)).split()
        if words:
            linked = min(len(words), len(html.unescape(" ".join(block.linked)).split())) if block.linked else 0
            if block.box is not None:
                block.box.words += len(words) - linked
            else:
                free += len(words) - linked
            out.append((" ".join(words), len(words), linked / len(words), block.box))
    _mark_most(boxes, free)
    return [(text, n, links, box.place() if box is not None else 0) for text, n, links, box in out]


def main_text(page: str | None, tree: Node | None = None) -> str:
    """The blocks of a page that the tree takes for main text, two line ends between them; '' if there are none."""
    tree, own = tree or default_tree(), blocks(page or "")
    edge = ("", 0, 0.0, 0)
    kept = []
    for before, block, after in zip([edge, *own], own, [*own[1:], edge], strict=False):
        if is_main(tree, (block[1], block[2], before[1], before[2], after[1], after[2], block[3])):
            kept.append(block[0])
    return "\n\n".join(kept)


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract_main_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars``, its code points; columns with these names are replaced.

    Whole pages are read, also broken ones; a null or empty page has the text ''. References such as ``&amp;`` are
    decoded, and white space inside a block becomes one space. Pages stay where they are.
    """
    text = _extract.asNondeterministic()(F.col(page))
    return pages.drop(*({"text", "n_chars"} - {page})).withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op7_main_text")
def op7(spark, sf):
    """Every page's main text."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
