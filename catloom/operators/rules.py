"""Extraction rules: small driver-side objects that compile to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import JavaPattern, trim_ws
from .selectors import Selector, select_nodes

# Field names of list records, and how many region rules a layer has.
COMMON_FIELDS = (
    "link main_title sub_title main_image sub_images view_count favorite_count comment_count "
    "main_owner_name main_owner_id main_owner_link sub_owner_name sub_owner_id sub_owner_link"
).split()
PRODUCT_FIELDS = "price price_currency price_text sales_count sales_text".split()
REGION_RULES = 5


@dataclass(frozen=True)
class FieldRule:
    css: str = ""
    xpath: str = ""
    attr: str = ""
    regex: str = ""
    combine: str = ""
    father_css: str = ""
    father_xpath: str = ""
    father_child_max_count: int = -1


@dataclass(frozen=True)
class RegionRule:
    css: str = ""
    xpath: str = ""
    child_block: int = 1
    child_max_count: int = -1
    fields: tuple[str, ...] = ()
    combine_fields: tuple[str, ...] = ()


def strip_regex_prefix(regex: str) -> str:
    return regex.removeprefix("regex:")


def apply_regex(value: Column, regex: str) -> Column:
    """PRJ-05: first match (its group 1 if it has groups); no match keeps the value."""
    pattern_text = strip_regex_prefix(regex) if regex else ""
    if not pattern_text:
        return value
    pattern = JavaPattern(pattern_text)
    if not pattern.valid:
        raise ValueError(f"bad pattern in rule: {regex!r}")
    return F.when(value.rlike(pattern.text), F.regexp_extract(value, pattern.text, pattern.group)).otherwise(value)


def cut(values: Column, count: int) -> Column:
    """SRT-03 / WIN-03: first ``count`` entries, all of them for -1.

    A negative count below -1 drops that many entries from the end.
    """
    if count == -1:
        return values
    if count >= 0:
        return F.slice(values, 1, count)
    return F.slice(values, F.lit(1), F.greatest(F.size(values) + count, F.lit(0)))


def field_values(nodes: Column, rule: FieldRule, lo: Column, hi: Column, max_count: int = -1) -> Column:
    """PRJ-02/03/05/07/10: the cleaned values one rule finds in one region.

    With a father selector the rule is evaluated inside all its matches together,
    and the father's own limit replaces the caller's.
    """
    empty = F.array().cast("array<string>")
    selector = Selector.of(rule.css, rule.xpath)
    if rule.combine or not selector.chains:
        return empty
    if rule.father_css or rule.father_xpath:
        father = Selector.of(rule.father_css, rule.father_xpath)
        max_count = rule.father_child_max_count
        ranges = F.transform(father.ids(nodes, lo, hi), lambda f: selector.ids(nodes, f, F.get(nodes, f)["end_id"]))
        found = F.transform(F.array_sort(F.array_distinct(F.flatten(ranges))), lambda i: F.get(nodes, i))
    else:
        found = select_nodes(nodes, selector, lo, hi)
    read = (
        (lambda n: F.coalesce(F.try_element_at(n.attrs, F.lit(rule.attr.lower())), F.lit("")))
        if rule.attr
        else (lambda n: n.text)
    )
    values = F.transform(found, lambda n: trim_ws(F.coalesce(apply_regex(read(n), rule.regex), F.lit(""))))
    return cut(values, max_count)


def regions(nodes: Column, rules: list[RegionRule]) -> tuple[list[tuple[int, RegionRule, Column]], bool]:
    """PRJ-06: the block rules in force, each with its array of matching elements.

    A rule counts when it has a selector, enabled fields and ``child_block == 1``.
    When none does, the whole page is the one region; the rule set decides that,
    not the single page.
    """
    if len(rules) > REGION_RULES:
        raise ValueError(f"at most {REGION_RULES} region rules")
    active = []
    for unit, rule in enumerate(rules):
        if (rule.css or rule.xpath) and rule.fields and rule.child_block == 1:
            active.append((unit, rule, _page_matches(nodes, Selector.of(rule.css, rule.xpath))))
    return active, bool(active)


def _page_matches(nodes: Column, selector: Selector) -> Column:
    return select_nodes(nodes, selector, F.lit(-1), F.size(nodes) - 1)


def text_tags(rules: list[FieldRule]) -> set[str] | None:
    """Tags whose text the rules read; None when a rule may read any tag's text."""
    wanted: set[str] = set()
    for rule in rules:
        if rule.attr or rule.combine:
            continue
        tags = Selector.of(rule.css, rule.xpath).target_tags()
        if tags is None:
            return None
        wanted |= tags
    return wanted


def with_father(rule: FieldRule, region: RegionRule) -> FieldRule:
    """Father mode: a region rule with ``child_block == 0`` gives its fields a search range."""
    if region.child_block == 1:
        return rule
    return replace(
        rule, father_css=region.css, father_xpath=region.xpath, father_child_max_count=region.child_max_count
    )
