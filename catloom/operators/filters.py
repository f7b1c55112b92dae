"""Row predicates (FLT-01 .. FLT-19) as boolean Columns that never return NULL."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import JavaPattern, col, let, trim_ws
from ..specs import IndexSpec, Scope, filter_field, parse_range

Range = tuple[Decimal, Decimal]


_NUMBER = r"\A([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,9}))?\z"
_MIDDLE = 10_000_000_000  # exponents are written with this added, so they have eleven digits


def decimal_key(value) -> Column:
    """A text that sorts as the decimal number does, of any number of digits; NULL for what is no number.

    The sign, then the place of the first digit that isn't 0, then the digits from there on. For numbers below 0 every digit is
    replaced by its complement to 9, and an end mark above all digits puts a longer fraction below a shorter one.
    Exponents have at most nine digits.
    """

    def key(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, _NUMBER, i)
        whole, rest = part(2), part(3)
        shape = F.regexp_like(text, F.lit(_NUMBER)) & (F.length(whole) + F.length(rest) > 0)
        digits = F.regexp_replace(F.concat(whole, rest), r"\A0+", "")
        place = F.length(whole) - (F.length(whole) + F.length(rest) - F.length(digits)) + F.coalesce(part(4).try_cast("bigint"), F.lit(0))
        size = F.concat(F.lpad((place + _MIDDLE).cast("string"), 11, "0"), F.regexp_replace(digits, r"0+\z", ""))
        below = F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))
        signed = F.when(part(1) == "-", below).otherwise(F.concat(F.lit("2"), size))
        return F.when(shape, F.when(digits == "", F.lit("1")).otherwise(signed))

    return let(trim_ws(col(value).cast("string")), key)


def in_range(value, bounds: Range) -> Column:
    """Inclusive decimal range of any precision; blank or non-numeric values are outside."""
    low, high = (decimal_key(F.lit(str(b))) for b in bounds)
    exact = decimal_key(value).between(low, high)
    if all(b.is_finite() and abs(b) < 10**27 and -b.as_tuple().exponent <= 10 for b in bounds):
        # Most numbers are short: a decimal type holds them and the bounds exactly, and its comparison is cheaper.
        few, many = (F.lit(f"{b:f}").cast("decimal(38,10)") for b in bounds)
        text = trim_ws(col(value).cast("string"))
        short = F.regexp_like(text, F.lit(r"\A[+-]?\d{1,15}(\.\d{1,10})?\z"))
        exact = F.when(short, text.try_cast("decimal(38,10)").between(few, many)).otherwise(exact)
    return F.coalesce(exact, F.lit(False))


def allow_range(value, bounds: Range | None) -> Column:
    """FLT-01; ``value`` None means that no field was named."""
    if bounds is None:
        return F.lit(True)
    return F.lit(False) if value is None else in_range(value, bounds)


def reject_range(value, bounds: Range | None) -> Column:
    """FLT-02: drop rows inside the range, keep non-numeric ones."""
    if bounds is None:
        return F.lit(True)
    return F.lit(False) if value is None else ~in_range(value, bounds)


def not_blank(value) -> Column:
    return trim_ws(F.coalesce(col(value).cast("string"), F.lit(""))) != ""


def all_present(values: Sequence[Column | str]) -> Column:
    """FLT-03."""
    return reduce(lambda a, b: a & b, [not_blank(v) for v in values], F.lit(True))


def any_present(values: Sequence[Column | str]) -> Column:
    """FLT-04; a list without usable names lets nothing through."""
    return reduce(lambda a, b: a | b, [not_blank(v) for v in values], F.lit(False))


@dataclass(frozen=True)
class RecordFilter:
    """The four record rules of a list page, AND-ed (FLT-01 .. FLT-06)."""

    allow_field: str = ""
    allow_range: str = ""
    reject_field: str = ""
    reject_range: str = ""
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()

    def condition(self) -> Column:
        named = lambda n: _record_value(n) if n.strip() else None
        listed = lambda ns: [_record_value(n) for n in ns if n.strip()]
        out = allow_range(named(self.allow_field), parse_range(self.allow_range))
        out = out & reject_range(named(self.reject_field), parse_range(self.reject_range))
        out = out & all_present(listed(self.all_of))
        return out & any_present(listed(self.any_of)) if self.any_of else out

    def split(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """FLT-05: ``(valid, invalid)``; both read one flag column."""
        flagged = records.withColumn("is_valid", self.condition())
        return (
            flagged.filter("is_valid").drop("is_valid"),
            flagged.filter("not is_valid").drop("is_valid"),
        )


def _record_value(name: str) -> Column:
    target = filter_field(name)
    if target is None:
        return F.lit("")
    struct, field = target
    value = F.col(f"{struct}.{field}" if struct else field)
    return F.coalesce(value.cast("string"), F.lit(""))


# ---------------------------------------------------------------- scope

def allow_index(index, spec: IndexSpec) -> Column:
    """FLT-08: position filter on one side of a scope."""
    return spec.contains(col(index))


def in_scope(ids_path, scope: Scope | None, *, index_empty: bool = False) -> Column:
    """FLT-09: first id among the parents and second among the children."""
    if index_empty or scope is None or scope.everything:
        return F.lit(True)
    ids = col(ids_path)
    parent = F.lit(True) if scope.parents.everything else scope.parents.contains(F.get(ids, F.lit(0)))
    child = F.lit(True) if scope.children.everything else scope.children.contains(F.get(ids, F.lit(1)))
    return F.coalesce(parent & child, F.lit(False))


def level_open(level, switches: Sequence[bool], last_level: int) -> Column:
    """FLT-18: levels that are switched on, up to the last one."""
    on = [n for n, is_on in enumerate(switches) if is_on and n <= last_level]
    return col(level).isin(*on) if on else F.lit(False)


def within_limit(limit_id, ids_path) -> Column:
    """FLT-19: -1 is open, otherwise the first id must be the limit."""
    limit = col(limit_id)
    return F.coalesce((limit == -1) | (F.get(col(ids_path), F.lit(0)) == limit), F.lit(False))


# ---------------------------------------------------------------- links

def full_match(url, regex: str) -> Column:
    """FLT-13: the whole URL matches, ignoring case; blank passes all, a bad pattern none."""
    if not regex.strip():
        return F.lit(True)
    pattern = JavaPattern(regex.strip(), ignore_case=True)
    return col(url).rlike(pattern.full()) if pattern.valid else F.lit(False)


def start_id_gate(url, *, low: int = 0, high: int = 0, denied: Collection[str] = ()) -> Column:
    """FLT-14: gate on a trailing ``=number``; a deny list replaces the limits."""
    u = col(url)
    tail = F.regexp_extract(u, r"=([^=]*)\z", 1)
    numbered = tail.rlike(r"\A\d+\z")
    if denied:
        passes = ~tail.isin(*denied)
    else:
        number = tail.try_cast("decimal(38,0)")
        passes = F.lit(True)
        if low > 0:
            passes = passes & (number >= low)
        if high > 0:
            passes = passes & (number <= high)
    return F.coalesce(F.when(numbered, passes).otherwise(True), F.lit(True))
