"""Small Column helpers shared by all parsers: regex groups, rounding, numbers as text."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word boundary of ASCII letters, digits and underscore, whatever the regex engine's own \b takes for a word.
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def pattern(regex: str) -> str:
    """``regex`` with every ``\\b`` read as an ASCII word boundary.

    In front of a letter or digit the boundary is a look back from that character, so that only places with it are looked at.
    """
    return re.sub(r"\\b([A-Za-z0-9])(?![?*+{])", r"\1(?<![A-Za-z0-9_]\1)", regex).replace(r"\b", _EDGE)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named there: an array of one is transformed."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mentions(text: Column, fragments: tuple[str, ...]) -> Column:
    """Whether one of the fragments occurs, a search that costs a small part of a regex's."""
    return functools.reduce(operator.or_, (F.contains(text, F.lit(x)) for x in fragments))


def matches(text: Column, regex: str, fragments: tuple[str, ...] = ()) -> Column:
    """Whether the regex occurs; false for null. Only texts with one of ``fragments``, which all its matches have, are searched with it."""
    found = text.rlike(pattern(regex))
    return F.coalesce(mentions(text, fragments) & found if fragments else found, F.lit(False))


def group(text: Column, regex: str, number: int = 1) -> Column:
    """A group of the first match, null if nothing matched or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern(regex), number), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def within(value: Column, low: float, high: float, open_low: bool = False) -> Column:
    """The value if it lies in the range, else null."""
    return F.when((value > low if open_low else value >= low) & (value <= high), value)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Floor of the scaled value plus one half: half goes up, as binary doubles have it."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def plain_number(value: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    value = value.cast("double")
    whole = value == F.floor(value).cast("double")
    return F.when(whole & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def compact(*items: Column) -> Column:
    """An array of those items that are not null."""
    return F.array_compact(F.array(*(i.cast("string") for i in items)))
