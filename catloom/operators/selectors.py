"""CSS and XPath selectors, parsed on the driver and compiled to Column expressions over a page's element array.

CSS: tags, ``*``, ``.class``, ``#id``, attribute tests, ``:first-child``, ``:last-child``, ``:only-child``, the
``nth`` family and its ``of-type`` forms, ``:not()``, ``:has()``, ``:empty``, the four combinators, lists.
XPath: ``/`` and ``//`` steps, ``following-sibling::``, ``|``, predicates with positions, ``last()``, attributes, ``text()``, ``.``,
``contains``, ``starts-with``, ``not``, ``and``, ``or``. Anything else raises ``ValueError`` before a job runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.base import let

# A test takes the page's elements and one of them.
Test = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Step:
    link: str  # ' ' descendant, '>' child, '+' next sibling, '~' later sibling, '/' root
    tag: str
    tests: tuple[Test, ...] = ()

    def holds(self, nodes: Column, node: Column) -> Column:
        out = F.lit(True) if self.tag == "*" else node.tag == self.tag
        for test in self.tests:
            out = out & F.coalesce(test(nodes, node), F.lit(False))
        return out


class _Text:
    """A cursor over a selector."""

    def __init__(self, source: str):
        self.source, self.at = source, 0

    def fail(self) -> ValueError:
        return ValueError(f"selector not supported at {self.at}: {self.source!r}")

    def take(self, pattern: str) -> re.Match | None:
        hit = re.compile(pattern, re.ASCII).match(self.source, self.at)
        if hit:
            self.at = hit.end()
        return hit

    def need(self, pattern: str) -> re.Match:
        if (hit := self.take(pattern)) is None:
            raise self.fail()
        return hit

    @property
    def done(self) -> bool:
        return self.at >= len(self.source)


_NAME = r"-?[A-Za-z_\u0080-\U0010FFFF][\w\u0080-\U0010FFFF-]*"
_QUOTED = r"\"([^\"]*)\"|'([^']*)'"


def _quoted(hit: re.Match, first: int = 1) -> str:
    return next((g for g in hit.groups()[first - 1 :] if g is not None), "")


def _attribute(name: str, op: str, value: str) -> Test:
    def test(_: Column, node: Column) -> Column:
        have = F.try_element_at(node.attrs, F.lit(name))
        if op == "":
            return have.isNotNull()
        if op == "=":
            return have == value
        if op == "~=":
            return have.rlike(r"(?:\A|\s)" + re.escape(value) + r"(?:\s|\z)") & F.lit(value != "")
        if op == "|=":
            return (have == value) | F.startswith(have, F.lit(value + "-"))
        part = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op]
        return part(have, F.lit(value)) & F.lit(value != "")

    return test


def _nth(field: str, a: int, b: int) -> Test:
    """The place in ``field`` is ``a * k + b`` for some ``k`` from 0."""

    def test(_: Column, node: Column) -> Column:
        off = node[field] - b
        if a == 0:
            return off == 0
        return (F.pmod(off, F.lit(abs(a))) == 0) & (off >= 0 if a > 0 else off <= 0)

    return test


# Pseudo-classes without arguments as tests of a place among the parent's elements.
_PLACES = {
    "first-child": [("pos", 0, 1)], "last-child": [("pos_back", 0, 1)], "only-child": [("pos", 0, 1), ("pos_back", 0, 1)],
    "first-of-type": [("type_pos", 0, 1)], "last-of-type": [("type_back", 0, 1)], "only-of-type": [("type_pos", 0, 1), ("type_back", 0, 1)],
}
_NTH = {"nth-child": "pos", "nth-last-child": "pos_back", "nth-of-type": "type_pos", "nth-last-of-type": "type_back"}


def _formula(text: _Text) -> tuple[int, int]:
    if text.take(r"\s*odd\s*"):
        return 2, 1
    if text.take(r"\s*even\s*"):
        return 2, 0
    if hit := text.take(r"\s*([+-]?\d*)n\s*(?:([+-])\s*(\d+))?\s*"):
        a = int(hit[1] + "1") if hit[1] in ("", "+", "-") else int(hit[1])
        return a, int((hit[2] or "+") + (hit[3] or "0"))
    return 0, int(text.need(r"\s*([+-]?\d+)\s*")[1])


def _pseudo(text: _Text, name: str) -> list[Test]:
    if name in _PLACES:
        return [_nth(*place) for place in _PLACES[name]]
    if name == "empty":
        return [lambda _, node: (node.end_id == node.node_id) & (node.text == "")]
    if name in _NTH:
        text.need(r"\(")
        a, b = _formula(text)
        text.need(r"\)")
        return [_nth(_NTH[name], a, b)]
    if name in ("not", "has"):
        text.need(r"\(\s*")
        inner = [_compound(text, ">" if name == "has" and text.take(r">\s*") else " ")]
        while text.take(r"\s*,\s*"):
            inner.append(_compound(text, ">" if name == "has" and text.take(r">\s*") else " "))
        text.need(r"\s*\)")
        if name == "not":
            return [partial(lambda step, nodes, node: ~step.holds(nodes, node), step) for step in inner]

        def has(nodes: Column, node: Column) -> Column:
            below = F.slice(nodes, node.node_id + 2, node.end_id - node.node_id)
            found = F.lit(False)
            for step in inner:
                found = found | F.exists(below, partial(_inside, step, nodes, node))
            return found

        return [has]
    raise text.fail()


def _inside(step: Step, nodes: Column, outer: Column, node: Column) -> Column:
    own = step.holds(nodes, node)
    return own & (node.parent_id == outer.node_id) if step.link == ">" else own


def _compound(text: _Text, link: str) -> Step:
    head = text.take(rf"\*|{_NAME}")
    tests: list[Test] = []
    while not text.done:
        if hit := text.take(rf"\.({_NAME})"):
            tests.append(_attribute("class", "~=", hit[1]))
        elif hit := text.take(r"#([\w\u0080-\U0010FFFF-]+)"):
            tests.append(_attribute("id", "=", hit[1]))
        elif hit := text.take(rf"\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:{_QUOTED}|([\w-]+)))?\s*\]"):
            tests.append(_attribute(hit[1].lower(), hit[2] or "", _quoted(hit, 3)))
        elif hit := text.take(rf":({_NAME})"):
            tests += _pseudo(text, hit[1].lower())
        else:
            break
    if head is None and not tests:
        raise text.fail()
    return Step(link, head[0].lower() if head else "*", tuple(tests))


def parse_css(source: str) -> list[list[Step]]:
    text, chains = _Text(source.strip()), []
    while True:
        chain = [_compound(text, " ")]
        while not text.done and not re.compile(r"\s*,").match(text.source, text.at):
            chain.append(_compound(text, text.need(r"\s*([>+~])\s*|\s+")[1] or " "))
        chains.append(chain)
        if text.done:
            return chains
        text.need(r"\s*,\s*")


def _value(text: _Text) -> Callable[[Column], Column]:
    if hit := text.take(r"\s*@([\w:-]+)\s*"):
        return lambda node: F.try_element_at(node.attrs, F.lit(hit[1].lower()))
    if text.take(r"\s*normalize-space\(\s*(?:\.|text\(\))?\s*\)\s*") or text.take(r"\s*(?:text\(\)|\.)\s*"):
        return lambda node: node.text
    raise text.fail()


def _primary(text: _Text, tag: str, first: bool) -> Test:
    if text.take(r"\s*not\(\s*"):
        inner = _either(text, tag, False)
        text.need(r"\s*\)\s*")
        return lambda nodes, node: ~F.coalesce(inner(nodes, node), F.lit(False))
    if hit := text.take(r"\s*(contains|starts-with)\(\s*"):
        value = _value(text)
        part = _quoted(text.need(rf"\s*,\s*(?:{_QUOTED})\s*\)\s*"))
        check = F.contains if hit[1] == "contains" else F.startswith
        return lambda _, node: check(F.coalesce(value(node), F.lit("")), F.lit(part))
    if text.take(r"\s*\("):
        inner = _either(text, tag, False)
        text.need(r"\s*\)\s*")
        return inner
    forward, backward = ("pos", "pos_back") if tag == "*" else ("type_pos", "type_back")
    # A place counts what the tests before it have left, so it must come first.
    place = text.take(r"\s*(?:position\(\)\s*(=|<=|>=|<|>)\s*)?(\d+)\s*") or text.take(r"\s*(?:position\(\)\s*(=)\s*)?(last)\(\)\s*")
    if place:
        if not first:
            raise text.fail()
        if place[2] == "last":
            return _nth(backward, 0, 1)
        n, op = int(place[2]), place[1] or "="
        return lambda _, node: {"=": node[forward] == n, "<": node[forward] < n, ">": node[forward] > n, "<=": node[forward] <= n, ">=": node[forward] >= n}[op]
    value = _value(text)
    if hit := text.take(rf"\s*(!?=)\s*(?:{_QUOTED})\s*"):
        want = _quoted(hit, 2)
        return lambda _, node: value(node) == want if hit[1] == "=" else value(node) != want
    return lambda _, node: value(node).isNotNull()


def _both(text: _Text, tag: str, first: bool) -> Test:
    tests = [_primary(text, tag, first)]
    while text.take(r"\s*and\b\s*"):
        tests.append(_primary(text, tag, first))

    def test(nodes: Column, node: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t(nodes, node), F.lit(False))
        return out

    return test


def _either(text: _Text, tag: str, first: bool) -> Test:
    tests = [_both(text, tag, first)]
    while text.take(r"\s*or\b\s*"):
        tests.append(_both(text, tag, first))

    def test(nodes: Column, node: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | F.coalesce(t(nodes, node), F.lit(False))
        return out

    return test


def parse_xpath(source: str) -> list[list[Step]]:
    text, chains = _Text(source.strip().removeprefix("xpath=").strip()), []
    while True:
        text.take(r"\.(?=/)")
        chain: list[Step] = []
        while hit := text.take(r"\s*(//|/)(following-sibling::)?(\*|[\w-]+)(?![\w(:@-])"):
            if hit[2] and (not chain or hit[1] == "//"):
                raise text.fail()
            link, tag, tests = "~" if hit[2] else " " if hit[1] == "//" else ">" if chain else "/", hit[3].lower(), []
            while text.take(r"\s*\["):
                tests.append(_either(text, tag, not tests and not hit[2]))
                text.need(r"\s*\]")
            chain.append(Step(link, tag, tuple(tests)))
        if not chain:
            raise text.fail()
        chains.append(chain)
        if text.done:
            return chains
        text.need(r"\s*\|\s*")


@dataclass(frozen=True)
class Selector:
    """A compiled selector: alternatives, each a chain of steps. Without any it finds nothing."""

    chains: tuple[tuple[Step, ...], ...] = ()

    @staticmethod
    def of(css: str = "", xpath: str = "") -> Selector:
        """CSS first, else XPath, else nothing."""
        chains = parse_css(css) if css.strip() else parse_xpath(xpath) if xpath.strip() else []
        return Selector(tuple(map(tuple, chains)))

    def target_tags(self) -> set[str] | None:
        """Tags whose text the selector's elements or tests need; None when any tag is possible."""
        tags = {step.tag for chain in self.chains for step in chain}
        return None if "*" in tags else tags

    def ids(self, nodes: Column, lo: Column, hi: Column) -> Column:
        """Ids of the matching elements below ``lo`` (down to ``hi``), in document order; steps before the last may stand at ``lo``."""
        found = [_chain_ids(chain, nodes, lo, hi) for chain in self.chains]
        if not found:
            return F.array().cast("array<int>")
        return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def _related(link: str, node: Column, before: Column) -> Column:
    if link == ">":
        return F.exists(before, lambda s: s.node_id == node.parent_id)
    if link == " ":
        return F.exists(before, lambda s: (s.node_id < node.node_id) & (node.node_id <= s.end_id))
    if link == "+":
        return F.exists(before, lambda s: (s.parent_id == node.parent_id) & (s.pos == node.pos - 1))
    return F.exists(before, lambda s: (s.parent_id == node.parent_id) & (s.pos < node.pos))


def _chain_ids(chain: tuple[Step, ...], nodes: Column, lo: Column, hi: Column) -> Column:
    """One step after another: the elements that match a step and stand to one of the step before as its link says.

    An element lies in another if its id lies between the other's id and end, so no element needs a list
    of its ancestors, however deep the page.
    """

    def after(k: int, before: Column | None) -> Column:
        step, last = chain[k], k == len(chain) - 1
        start = lo + 1 if last else F.greatest(lo, F.lit(0))
        inside = F.slice(nodes, start + 1, F.greatest(hi - start + 1, F.lit(0)))

        def fits(node: Column) -> Column:
            own = step.holds(nodes, node)
            if before is not None:
                return own & _related(step.link, node, before)
            return own & (node.parent_id == -1) if step.link == "/" else own

        found = F.filter(inside, fits)
        if last:
            return F.transform(found, lambda n: n.node_id)
        narrow = F.transform(found, lambda n: F.struct(n.node_id.alias("node_id"), n.end_id.alias("end_id"), n.parent_id.alias("parent_id"), n.pos.alias("pos")))
        return let(narrow, lambda s: after(k + 1, s))

    return after(0, None)


def select_nodes(nodes: Column, selector: Selector, lo: Column, hi: Column) -> Column:
    """Elements below ``lo`` (down to ``hi``) that match, in document order."""
    return F.transform(selector.ids(nodes, lo, hi), lambda i: F.get(nodes, i))
