"""Text functions as column expressions; only entity decoding needs Python, and it runs on Arrow batches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .regex import find_all, sub
from . import urls


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip(text: Column) -> Column:
    return sub(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    pieces = find_all(text, r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+", 0)
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), ""
    )


def slug_title(slug: Column) -> Column:
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def normalise(text: Column) -> Column:
    """Lower case, apostrophes dropped, everything but letters a-z and digits squeezed to single spaces."""
    t = F.translate(F.lower(text), "'’", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    return strip(sub(text, r"\s+", " "))


def strip_tags(text: Column) -> Column:
    return sub(text, r"<[^>]+>", " ")


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " ")


def rot13(text: Column) -> Column:
    return F.translate(
        text,
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm",
    )


def location_parts(page_url: Column) -> Column:
    """Prettified path segments of a page URL, general to specific."""
    segments = F.filter(F.split(urls.path(page_url), "/"), lambda s: (s != "") & (s != "live-camera"))
    return F.transform(segments, slug_title)


def with_location(title: Column, parts: Column, drop: Column | None = None) -> Column:
    """Append the parts (general to specific) that the title does not name yet, specific first."""
    drop = F.lit("") if drop is None else F.coalesce(drop, F.lit(""))
    blank = strip(title) == ""
    state = F.struct(
        F.array().cast("array<string>").alias("extra"), F.array().cast("array<string>").alias("seen")
    )
    named, dropped = normalise(title), normalise(drop)

    def step(acc, part):
        n = normalise(part)
        fresh = (n != "") & (n != dropped) & ~F.array_contains(acc["seen"], n) & (blank | ~F.contains(named, n))
        return F.when(
            fresh,
            F.struct(
                F.concat(acc["extra"], F.array(part)).alias("extra"), F.concat(acc["seen"], F.array(n)).alias("seen")
            ),
        ).otherwise(acc)

    extra = F.aggregate(F.reverse(parts), state, step)["extra"]
    joined = F.array_join(extra, ", ")
    return (
        F.when(blank, F.when(joined == "", title).otherwise(joined))
        .when(F.size(extra) > 0, F.concat(title, F.lit(" — "), joined))
        .otherwise(title)
    )


def csv_set(setting: Column) -> Column:
    """A comma-separated setting as lower-case, trimmed, distinct, non-empty names."""
    names = F.transform(F.split(setting, ","), lambda p: F.lower(strip(p)))
    return F.array_distinct(F.filter(names, lambda p: p != ""))


def retry_after_seconds(header: Column) -> Column:
    """Seconds of a `Retry-After` header; a date, garbage or a number that is not positive gives null."""
    secs = strip(header).try_cast("double")
    return F.when(secs > 0, secs)
