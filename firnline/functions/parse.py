"""Lenient parsing of form text: whatever does not parse becomes NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firnline.functions.missing import ColumnOrName, as_col

# The two time layouts and the missing-value tokens seen in form exports.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm")
NULL_TOKENS = ("NA", "", "NaN")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def blank_to_null(c: ColumnOrName, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NULL for blanks and missing-value tokens, the text itself otherwise."""
    c = as_col(c)
    return F.when(~F.trim(c).isin(list(tokens)), c)


def parse_number(c: ColumnOrName) -> Column:
    """Text to double; anything but a decimal number is NULL."""
    text = F.trim(as_col(c))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def truncate(c: ColumnOrName) -> Column:
    """Whole part, toward zero; NULL when it does not fit an int."""
    return as_col(c).try_cast("int")


def digits(c: ColumnOrName) -> Column:
    """Keep digits, dot and minus only."""
    return F.regexp_replace(as_col(c), r"[^0-9.-]", "")


def parse_time(
    c: ColumnOrName, formats: Sequence[str] = TIME_FORMATS, min_year: int | None = None
) -> Column:
    """First format that fits, as zone-free time; NULL for bad text and, if asked for, years before `min_year`."""
    c = as_col(c)
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    return parsed if min_year is None else F.when(F.year(parsed) >= min_year, parsed)


def format_time(c: ColumnOrName, layout: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(as_col(c), layout)


def day_of(c: ColumnOrName, day_key: str | tuple[int, int] = "day") -> Column:
    """Day of month, or a fixed (start, length) slice of time text where a total was keyed that way."""
    if day_key == "day":
        return F.dayofmonth(as_col(c))
    start, length = day_key
    return F.substring(as_col(c), start, length)


def core_key(c: ColumnOrName, fold: bool = False) -> Column:
    """First letter of a core label ("3b" to "3"); case is kept unless `fold`."""
    key = F.substring(as_col(c), 1, 1)
    return F.lower(key) if fold else key


def decode_position(c: ColumnOrName, centre: str = "Centre") -> tuple[Column, Column]:
    """A position such as "N7.5" as (direction, distance); the centre has no distance."""
    c = as_col(c)
    direction = F.when(c == centre, c).otherwise(F.substring(c, 1, 1))
    distance = F.when(c != centre, parse_number(c.substr(F.lit(2), F.length(c))))
    return direction, distance


def paste(prefix: str, c: ColumnOrName) -> Column:
    """Prefix plus text, a missing text printed as NA."""
    return F.concat(F.lit(prefix), F.coalesce(as_col(c).cast("string"), F.lit("NA")))
