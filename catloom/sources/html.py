"""PRJ-01: raw HTML to addressable elements, one nested row per page.

``page_nodes`` keeps the elements of a page in one array on the page's own row.
A page is the unit of work, so every selector, region and field rule later runs
inside the row: the whole extraction needs no shuffle and no join.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_with_tasks

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("end_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        # Places among the elements and the elements of one tag below a parent, from 1, from the front and from the back.
        T.StructField("pos", T.IntegerType()),
        T.StructField("pos_back", T.IntegerType()),
        T.StructField("type_pos", T.IntegerType()),
        T.StructField("type_back", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

# Fixed values of the HTML standard: elements without content, raw-text elements,
# elements that stand on their own line, and what a new element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
RAW_DECODED = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul br option".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
P_LIMITS = frozenset("button td th caption html table".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), _html.unescape(double or single or bare))
    return found


class _Page:
    """Elements of one page in document order, as parallel lists."""

    def __init__(self, text_tags: frozenset[str] | None):
        self.text_tags = text_tags
        self.end: list[int] = []
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.depth: list[int] = []
        self.text: list[str] = []
        self.pieces: list[str] = []
        self.open: list[tuple[int, int]] = []  # (node id, first text piece)
        self.opened: dict[str, int] = {}  # how many of a tag are open

    def push(self, tag: str, attrs: dict[str, str]) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self.open[-1][0] if self.open else -1)
        self.depth.append(len(self.open))
        self.end.append(node)
        self.text.append("")
        return node

    def pop(self) -> None:
        node, start = self.open.pop()
        self.opened[self.tag[node]] -= 1
        self.end[node] = len(self.tag) - 1
        if self.text_tags is None or self.tag[node] in self.text_tags:
            self.text[node] = " ".join("".join(self.pieces[start:]).split())
        if self.tag[node] in BLOCK:
            self.pieces.append(" ")

    def places(self) -> list[tuple[int, int, int, int]]:
        """The places of all elements: each counts its parent's elements so far, then is taken from the whole number."""
        total: dict[tuple[int, str], int] = {}
        front = []
        for parent, tag in zip(self.parent, self.tag, strict=True):
            both = [(parent, ""), (parent, tag)]
            for key in both:
                total[key] = total.get(key, 0) + 1
            front.append([total[key] for key in both])
        return [
            (p, total[parent, ""] - p + 1, t, total[parent, tag] - t + 1)
            for (p, t), parent, tag in zip(front, self.parent, self.tag, strict=True)
        ]

    def close_to(self, names: Iterable[str], limits: Iterable[str]) -> None:
        """Close the outermost open element of ``names`` this side of ``limits``."""
        if not any(self.opened.get(name, 0) for name in names):
            return
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[at][0]]
            if tag in limits:
                return
            if tag in names:
                while len(self.open) > at:
                    self.pop()
                return

    def parse(self, source: str) -> _Page:
        at, size = 0, len(source)
        while at < size:
            hit = _TOKEN.search(source, at)
            stop = hit.start() if hit else size
            if stop > at:
                self.pieces.append(_html.unescape(source[at:stop]))
            if not hit:
                break
            at = hit.end()
            if hit["close"]:
                self._end_tag(hit["close"].lower())
            elif hit["open"] or hit["loose"]:
                at = self._start_tag(source, at, (hit["open"] or hit["loose"]).lower(), hit["attrs"] or hit["rest"] or "")
        while self.open:
            self.pop()
        return self

    def _end_tag(self, tag: str) -> None:
        if self.opened.get(tag, 0):
            while self.tag[self.open[-1][0]] != tag:
                self.pop()
            self.pop()

    def _start_tag(self, source: str, at: int, tag: str, attrs: str) -> int:
        if tag in CLOSES_P:
            self.close_to(("p",), P_LIMITS)
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag in BLOCK:
            self.pieces.append(" ")
        node = self.push(tag, _attributes(attrs))
        if tag in RAW or tag in RAW_DECODED:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            body = source[at : closing.start()] if closing else source[at:]
            if self.text_tags is None or tag in self.text_tags:
                body = _html.unescape(body) if tag in RAW_DECODED else body
                self.text[node] = " ".join(body.split())
            return closing.end() if closing else len(source)
        if tag not in VOID:
            self.open.append((node, len(self.pieces)))
            self.opened[tag] = self.opened.get(tag, 0) + 1
        return at


def _offsets(lists: list[list]) -> pa.Array:
    total, out = 0, [0]
    for items in lists:
        total += len(items)
        out.append(total)
    return pa.array(out, pa.int32())


def _nested(pages: list[_Page]) -> pa.Array:
    flat = lambda name: [x for p in pages for x in getattr(p, name)]
    attrs = flat("attrs")
    places = [x for p in pages for x in p.places()]
    i32 = pa.int32()
    struct = pa.StructArray.from_arrays(
        [
            pa.array([i for p in pages for i in range(len(p.tag))], i32),
            pa.array(flat("end"), i32),
            pa.array(flat("parent"), i32),
            pa.array(flat("depth"), i32),
            pa.array(flat("tag"), pa.string()),
            pa.MapArray.from_arrays(
                _offsets(attrs),
                pa.array([k for a in attrs for k in a], pa.string()),
                pa.array([v for a in attrs for v in a.values()], pa.string()),
            ),
            *[pa.array([p[k] for p in places], i32) for k in range(4)],
            pa.array(flat("text"), pa.string()),
        ],
        names=NODE.fieldNames(),
    )
    return pa.ListArray.from_arrays(_offsets([p.tag for p in pages]), struct)


def page_nodes(
    pages: DataFrame,
    *,
    html_col: str = "html",
    keep: Iterable[str] = ("page_id", "url"),
    text_tags: Iterable[str] | None = None,
    pages_per_batch: int = 64,
) -> DataFrame:
    """Pages with their elements as ``nodes ARRAY<STRUCT>``, in document order.

    ``text_tags`` names the tags whose text is wanted (all of them by default);
    rule compilers pass what their rules read, so the text of outer containers
    is not copied for nothing.
    """
    keep = list(keep)
    wanted = None if text_tags is None else frozenset(text_tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, pages_per_batch):
                part = batch.slice(start, pages_per_batch)
                sources = part.column(part.num_columns - 1).to_pylist()
                nodes = _nested([_Page(wanted).parse(s or "") for s in sources])
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [nodes], names=keep + ["nodes"])

    source = pages.select(*keep, F.col(html_col))
    schema = T.StructType(list(source.schema.fields[:-1]) + [T.StructField("nodes", T.ArrayType(NODE))])
    return source.mapInArrow(run, schema)


def html_nodes(pages: DataFrame, **options) -> DataFrame:
    """The node table: one row per element, keyed by ``(page_id, node_id)``."""
    nested = page_nodes(pages, **options)
    rest = [c for c in nested.columns if c != "nodes"]
    return nested.select(*rest, F.inline("nodes"))


ship_with_tasks(__name__)
