"""Column builders for texts; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation since Unicode 14, which the \p{P} of Java 17 lacks; letters below it cost one comparison.
NEWER = r"[\u061D-\x{12FF2}&&[\u061D\u1B7D\u1B7E\u2E53-\u2E5D\x{10F86}-\x{10F89}\x{116B9}\x{11B00}-\x{11B09}\x{11F43}-\x{11F4F}\x{12FF1}\x{12FF2}]]"
#: A run of neither white space nor punctuation, or one punctuation character (Unicode P and some ASCII symbols).
PRETOKEN = rf"(?U)[^\s\p{{P}}$+<=>^`|~{NEWER}]+|[\p{{P}}$+<=>^`|~{NEWER}]"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_truncate(c: Column, size: int) -> Column:
    """Strip, line ends to blanks, then the first ``size`` code points."""
    return F.substring(F.regexp_replace(strip(c), "\n", " "), 1, size)


def contains_any(c: Column, terms: list[str]) -> Column:
    """Case-insensitive: any term is a substring.  Terms that hold another term add nothing and go."""
    low = sorted({t.lower() for t in terms}, key=len)
    needed = [t for i, t in enumerate(low) if not any(s in t for s in low[:i])]
    value = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(t)) for t in needed], F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def pretokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PRETOKEN), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """Plain division, NULL over zero."""
    return F.when(bottom != 0, top / bottom)


def normalize_code(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit("."), F.lit(""))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` in a template replaced by values, in any order and number."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def signed(c: Column) -> Column:
    return F.format_string("%+.4f", c)


def fixed(c: Column, places: int = 2) -> Column:
    """A number as text with a fixed number of places."""
    return F.format_string(f"%.{places}f", c)


def rounded(c: Column, places: int = 4) -> Column:
    return F.round(c, places)


def padded(c: Column, size: int) -> Column:
    """Left-aligned in ``size`` characters; longer texts stay whole."""
    return F.when(F.char_length(c) >= size, c).otherwise(F.rpad(c, size, " "))
