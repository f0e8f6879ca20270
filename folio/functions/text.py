"""String helpers with Unicode-aware trimming.

Spark's ``trim`` strips only U+0020. Text fields here follow the
White_Space property (tab, LF, VT, FF, CR, space, U+0085, U+00A0, U+1680,
U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000), which is what Java's
``(?U)\\s`` matches; ``utrim`` trims exactly that set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once per row, however often ``f`` names it.

    Outside generated code (in lambdas, below ``from_xml``) nothing shares common
    subexpressions: an expression named n times is evaluated n times.
    """
    return F.get(F.transform(F.array(c), lambda x: f(x)), 0)


def has_any(c: Column, *parts: str) -> Column:
    found = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(c, F.lit(p))
    return found


def replace(c: Column, *pairs: tuple[str, str]) -> Column:
    """Replace strings, one pair after another, where there is any.

    Spark's ``replace`` compares the whole search string at every byte, several times as slow as
    ``contains``, so a text without any of them is not searched by it.
    """

    def every(s: Column) -> Column:
        for old, new in pairs:
            s = F.replace(s, F.lit(old), F.lit(new))
        return s

    return bound(c, lambda s: F.when(has_any(s, *[old for old, _ in pairs]), every(s)).otherwise(s))


def utrim(c: Column) -> Column:
    """Trim White_Space characters from both ends (a character-set trim, no regex)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """'' -> NULL (for ``concat_ws`` and for JSON omit-empty fields)."""
    return F.when(c != F.lit(""), c)


def empty_array_to_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def join_nonblank(items: Column, sep: str) -> Column:
    """Join the non-empty strings of an array."""
    return F.array_join(F.filter(items, lambda s: s != F.lit("")), sep)
