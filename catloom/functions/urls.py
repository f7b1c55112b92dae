"""URL, key and bucket expressions (SCL-40 .. SCL-47, SRT-04, PRJ-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let, trim_ws

_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_LINE_CHARS = "\t\r\n"
# Schemes whose links may be relative.
RELATIVE_SCHEMES = (
    "ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtspu rtsps sftp svn svn+ssh ws wss"
).split(" ")
# Href prefixes that do not lead to a page.
NON_PAGE_PREFIXES = ["#", "javascript:", "mailto:", "tel:", "data:"]


def url_parts(url) -> Column:
    """``struct(scheme, host, path, params, query, fragment)``, all non-null strings."""
    return let(F.translate(col(url), _LINE_CHARS, ""), _parts)


def _parts(u: Column) -> Column:
    part = lambda g: F.regexp_extract(u, _PARTS, g)
    full = part(3)
    # Parameters start at the first ';' of the last segment; most paths have none.
    has_params = F.contains(u, F.lit(";")) & full.rlike(r"(?s)(?:\A|/)[^/;]*;[^/]*\z")
    params = F.when(has_params, F.regexp_extract(full, r"(?s)(?:\A|/)[^/;]*;([^/]*)\z", 1)).otherwise("")
    path = F.when(has_params, F.regexp_extract(full, r"(?s)\A(.*?);[^/]*\z", 1)).otherwise(full)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("host"),
        path.alias("path"),
        params.alias("params"),
        F.when(F.contains(u, F.lit("?")), part(4)).otherwise("").alias("query"),
        F.when(F.contains(u, F.lit("#")), part(5)).otherwise("").alias("fragment"),
    )


def _assemble(scheme: Column, host: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    some = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")

    def rooted(full: Column) -> Column:
        slash = F.when((full != "") & ~F.startswith(full, F.lit("/")), "/").otherwise("")
        return F.when(host != "", F.concat(F.lit("//"), host, slash, full)).otherwise(full)

    head = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    full = let(F.concat(path, some(";", params)), rooted)
    return F.concat(head, full, some("?", query), some("#", fragment))


def _resolve(base_path: Column, path: Column) -> Column:
    """Merge a relative path into the base path and take out the dot segments."""
    base = F.split(base_path, "/")
    folder = F.when(F.element_at(base, -1) != "", F.slice(base, 1, F.size(base) - 1)).otherwise(base)
    own = F.split(path, "/")
    merged = F.concat(folder, own)
    middle = F.filter(F.slice(merged, 2, F.greatest(F.size(merged) - 2, F.lit(0))), lambda s: s != "")
    joined = F.when(
        F.size(merged) > 1,
        F.concat(F.slice(merged, 1, 1), middle, F.slice(merged, -1, 1)),
    ).otherwise(merged)
    segments = F.when(F.startswith(path, F.lit("/")), own).otherwise(joined)

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.array_append(done, segment))
        )

    def walk(s: Column) -> Column:
        kept = F.aggregate(s, F.array().cast("array<string>"), step)
        return F.array_join(
            F.when(F.element_at(s, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"
        )

    dotted = lambda s: F.exists(s, lambda x: x.isin(".", ".."))
    plain = lambda s: F.when(dotted(s), walk(s)).otherwise(F.array_join(s, "/"))
    return let(let(segments, plain), lambda r: F.when(r == "", "/").otherwise(r))


def join_parts(base: Column, base_url: Column, href: Column) -> Column:
    """:func:`url_join` for a base that is already split; bind both when joining many links."""

    def link(p: Column) -> Column:
        scheme = F.when(p.scheme != "", p.scheme).otherwise(base.scheme)
        foreign = (scheme != base.scheme) | ~scheme.isin(*RELATIVE_SCHEMES)
        own = p.host != ""
        here = ~own & (p.path == "") & (p.params == "")
        joined = _assemble(
            scheme,
            F.when(own, p.host).otherwise(base.host),
            F.when(own, p.path).when(here, base.path).otherwise(_resolve(base.path, p.path)),
            F.when(here, base.params).otherwise(p.params),
            F.when(here & (p.query == ""), base.query).otherwise(p.query),
            p.fragment,
        )
        return F.when(foreign, href).otherwise(joined)

    return F.when(base_url == "", href).when(href == "", base_url).otherwise(let(url_parts(href), link))


def url_join(base, href) -> Column:
    """Resolve ``href`` against the page it was found on."""
    return let(url_parts(base), lambda b: join_parts(b, col(base), col(href)))


def _quote_path(path: Column) -> Column:
    coded = F.url_encode(path)
    for old, new in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%25", "%")]:
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return coded


def normalize_url(url, *, encode_path: bool = True) -> Column:
    """Absolute http(s) URL without fragment, path percent-encoded; anything else -> ``''``."""
    def build(p: Column) -> Column:
        path = _quote_path(p.path) if encode_path else p.path
        return F.when(
            p.scheme.isin("http", "https") & (p.host != ""),
            _assemble(p.scheme, p.host, path, p.params, p.query, F.lit("")),
        ).otherwise("")

    return let(url_parts(trim_ws(F.coalesce(col(url), F.lit("")))), build)


def is_page_href(href) -> Column:
    """FLT-12: false for empty links and links that do not lead to a page."""
    return let(F.lower(trim_ws(F.coalesce(col(href), F.lit("")))), _leads_somewhere)


def _leads_somewhere(h: Column) -> Column:
    bad = h == ""
    for prefix in NON_PAGE_PREFIXES:
        bad = bad | F.startswith(h, F.lit(prefix))
    return ~bad


def normalize_link(href, base) -> Column:
    """PRJ-17: link of a page as a normalised URL, NULL when it leads nowhere."""

    def link(h: Column) -> Column:
        found = let(normalize_url(url_join(base, h)), lambda u: F.when(u != "", u))
        return F.when(is_page_href(h), found)

    return let(trim_ws(F.coalesce(col(href), F.lit(""))), link)


def clean_url(url) -> Column:
    """Cut at the first ``>``."""
    return F.substring_index(col(url), ">", 1)


def bucket_suffix(doc_id, length: int = 2) -> Column:
    return F.right(col(doc_id), F.lit(length))


def store_bucket(doc_id, prefix: str, length: int = 2) -> Column:
    """Store bucket ``PREFIX-XX`` with an upper-case hash tail."""
    return F.concat(F.lit(prefix + "-"), F.upper(bucket_suffix(doc_id, length)))


def cache_key(doc_id, prefix: str, length: int = 2) -> Column:
    """Cache key ``prefix:xx:id``; its tail keeps the case of the id."""
    return F.concat(F.lit(prefix + ":"), bucket_suffix(doc_id, length), F.lit(":"), col(doc_id))


def head_key(template: str, sort_field, sort_order) -> Column:
    f, o = col(sort_field), F.coalesce(col(sort_order), F.lit(""))
    return F.concat(F.lit(template + ":"), f, F.when(o != "", F.concat(F.lit("-"), o)).otherwise(""))


def make_key(head, key, separator: str = ":") -> Column:
    return F.concat(col(head), F.lit(separator), col(key).cast("string"))


def field_ttl(sort_field, ttl_seconds: dict[str, int]) -> Column:
    """Time to live of a sort field; NULL means the key never expires."""
    if not ttl_seconds:
        return F.lit(None).cast("bigint")
    pairs = [F.lit(x) for kv in ttl_seconds.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(sort_field)).cast("bigint")


def order_query(url, names: list[str] | None = None, mode: str = "0") -> Column:
    """SRT-04: query parameters in a fixed order; listed names first, the rest by mode."""
    if mode not in ("asc", "desc", "0", ""):
        raise ValueError(f"unknown parameter order: {mode!r}")
    u, names = col(url), names or []
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    head, tail = F.regexp_extract(u, r"\A([^?#]*)", 1), F.regexp_extract(u, r"(#.*)\z", 1)
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    name = lambda p: F.substring_index(p, "=", 1)
    # Position in the list, then either the original position or the name itself.
    ranked = F.transform(
        F.split(query, "&"),
        lambda p, i: F.struct(
            F.coalesce(F.nullif(F.array_position(listed, name(p)), F.lit(0).cast("bigint")), F.lit(1 << 30)).alias("rank"),
            (name(p) if mode in ("asc", "desc") else F.lit("")).alias("name"),
            i.alias("at"), p.alias("pair"),
        ),
    )
    first = F.array_sort(F.filter(ranked, lambda r: r["rank"] < (1 << 30)))
    rest = F.filter(ranked, lambda r: r["rank"] == (1 << 30))
    rest = F.sort_array(rest, asc=False) if mode == "desc" else F.array_sort(rest)
    pairs = F.transform(F.concat(first, rest), lambda r: r["pair"])
    return F.when(query != "", F.concat(head, F.lit("?"), F.array_join(pairs, "&"), tail)).otherwise(u)


def page_url(base, number, param: str, *, hide_value: int = -1, offset_size: int = -1) -> Column:
    """PRJ-25: URL of one page; the page numbered ``hide_value`` keeps the bare URL."""
    b, n = col(base), col(number)
    value = n if offset_size == -1 else n * offset_size
    mark = F.when(F.contains(b, F.lit("?")), "&").otherwise("?")
    full = F.concat(b, mark, F.lit(param + "="), value.cast("string"))
    return F.when(n == hide_value, b).otherwise(full) if hide_value != -1 else full
