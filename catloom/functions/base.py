"""Helpers shared by the Column libraries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a value is trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Trim every Unicode white-space character; Spark's ``trim`` only knows the space."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A Column used twice inside a lambda is evaluated twice per element; a
    one-element array binds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements, each seeing the result of the one before."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def cut_before(c: Column, mark: str) -> Column:
    """Everything in front of the first ``mark`` (all of it when there is none)."""
    return F.substring_index(c, mark, 1)


class JavaPattern:
    """A rule's regular expression, checked on the driver and spelled for the JVM.

    ``valid`` is false for patterns that do not compile, so that callers can fold
    the whole expression to its "no match" constant instead of failing in a task.
    """

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.source = pattern
        try:
            compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
        except re.error:
            self.valid, self.groups, self.text = False, 0, ""
            return
        self.valid = True
        self.groups = compiled.groups
        text = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
        text = re.sub(r"\\Z", r"\\z", text)
        # d: only \n ends a line; U: \d, \w, \s and \b know Unicode.
        flags = "d" + ("iu" if ignore_case else "")
        if re.search(r"\\[dDwWsSbB]", pattern):
            flags += "U"
        self.text = f"(?{flags}){text}"

    @property
    def group(self) -> int:
        return 1 if self.groups else 0

    def followed_by(self, text: str) -> str:
        end = self.text.index(")") + 1
        return f"{self.text[:end]}(?:{self.text[end:]})(?:{text})"

    def full(self) -> str:
        end = self.text.index(")") + 1
        return f"{self.text[:end]}\\A(?:{self.text[end:]})\\z"
