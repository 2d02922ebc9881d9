"""Regular expressions with the meaning they have for Unicode text: `.` and `$` know only the newline as a line end, and
`\\w`, `\\b`, `\\s`, `\\d` and case folding cover all of Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def rx(pattern: str, ignore_case: bool = False, dot_all: bool = False, multiline: bool = False) -> str:
    flags = "dU" + ("i" if ignore_case else "") + ("s" if dot_all else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def has(col: Column, pattern: str, **flags) -> Column:
    return col.rlike(rx(pattern, **flags))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Give a value a name inside an expression, so that it is computed once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def first(col: Column, pattern: str, group: int = 1, maybe_empty: bool = False, **flags) -> Column:
    """The group of the first match, or null when nothing matches.

    An empty group also gives null unless `maybe_empty` is set; telling the two apart costs a second search.
    """
    p = rx(pattern, **flags)
    if maybe_empty:
        return F.when(col.rlike(p), F.regexp_extract(col, p, group))
    return F.nullif(F.regexp_extract(col, p, group), F.lit(""))


def first_once(col: Column, pattern: str, group: int = 1, **flags) -> Column:
    """`first` for places where a shared value cannot be pulled out by the optimizer: inside lambdas and branches."""
    return let(F.regexp_extract(col, rx(pattern, **flags), group), lambda m: F.when(m != "", m))


def first_or_empty(col: Column, pattern: str, group: int = 1, **flags) -> Column:
    return F.regexp_extract(col, rx(pattern, **flags), group)


def find_all(col: Column, pattern: str, group: int = 1, **flags) -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, **flags)), F.lit(group))


def sub(col: Column, pattern: str, replacement: str = "", **flags) -> Column:
    return F.regexp_replace(col, rx(pattern, **flags), replacement)
