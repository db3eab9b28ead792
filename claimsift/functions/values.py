"""Null, NaN, time and number handling that later steps rely on.

A missing number is NULL from ingest on: Spark orders NaN above every number
and lets it poison averages, so no comparison may see one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000

# Accepted dates beside ISO text. A column is read by one of them; where two fit
# as many of its cells, by the one that stands first here.
DATE_FORMATS = (
    "M/d/yyyy",
    "M-d-yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy/M/d",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
# What may follow a date: nothing, a clock of 12 hours or one of 24.
CLOCK = "[ h:m[:s] a][ H:m[:s]]"
# How the parts of those dates look: month, day, year and a month's name.
PARTS = {
    "yyyy": "[+-]?[0-9]{4,}",
    "MMMM": "(?:[^0-9 ]{4,}|[Mm][Aa][Yy])",
    "MMM": "[^0-9 ]{3}",
    "M": "0*(?:1[0-2]|[1-9])",
    "d": "0*(?:3[01]|[12][0-9]|[1-9])",
}

# Cell texts of a CSV file that mean "no value".
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def nan_to_null(column: Column) -> Column:
    """NaN becomes NULL; infinities stay.

    The column stands in it once: a filter that is pushed below several of
    these would else hold it so often that its code is no longer compiled.
    """
    return F.nanvl(column, F.lit(None))


def finite_or_null(column: Column) -> Column:
    """NaN and both infinities become NULL."""
    infinite = F.abs(column) == F.lit(float("inf"))
    return F.when(~F.isnan(column) & ~infinite, column)


def missing_to_null(column: Column) -> Column:
    """CSV texts that stand for a missing value become NULL."""
    return F.when(~column.isin(*MISSING_TEXTS), column)


def holds(predicate: Column) -> Column:
    """A predicate that is false, not unknown, where an input is missing."""
    return F.coalesce(predicate, F.lit(False))


def parse_iso(text: Column) -> Column:
    """ISO text to timestamp, which no other layout can be taken for."""
    return F.try_to_timestamp(F.btrim(text))


def shape(layout: str) -> str:
    """A pattern that every text in a layout begins with."""
    return "^" + re.sub("yyyy|MMMM|MMM|M|d|[.]", lambda part: PARTS.get(part[0], "[.]"), layout)


def parse_layout(text: Column, layout: str) -> Column:
    """Text in one of ``DATE_FORMATS``, with or without a clock, to timestamp.

    Spark's parser throws and catches an exception for a text it cannot read,
    which takes many times a parse; texts of another shape do not reach it.
    """
    cell = F.btrim(text)
    return F.when(cell.rlike(shape(layout)), F.try_to_timestamp(cell, F.lit(layout + CLOCK)))


def parse_timestamp(text: Column, layouts: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Text to timestamp, NULL where neither ISO nor a layout fits.

    Meant for a column's own layout (see ``features.time_layouts``). With
    several, a cell takes the first that fits: 5/3 is May 3 and 13/3 March 13.
    """
    return F.coalesce(parse_iso(text), *[parse_layout(text, layout) for layout in layouts])


def whole_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, floored, in exact integer arithmetic."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    rest = F.pmod(micros, F.lit(DAY_MICROS))
    return F.call_function("div", micros - rest, F.lit(DAY_MICROS))


def truncated_percent(share: Column) -> Column:
    """Share to integer percent, cut toward zero."""
    return (share * F.lit(100)).cast("int")
