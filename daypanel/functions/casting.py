"""Typing of all-text columns.

A text value is trimmed, empty text is NULL, and a value that cannot be read
as its logical type becomes NULL rather than an error. The patterns below
narrow or widen Spark's own ``try_cast`` to the accepted spellings:

* an integer may be written ``1.5`` or ``1e3`` in ASCII digits and is then rounded, once;
* a number may not end in Java's ``d`` or ``f`` suffix;
* a date must name year, month and day, with one separator, ``-`` or ``/``;
  nothing but a time of day may follow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daypanel.schema import PanelSchema

FULL_DATE = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Digits that a decimal of 18 places has no room for: rounding to those places
# first could reach a half that the number itself does not.
SURPLUS = r"^([^eE.]*\.[0-9]{18})[0-9]+$"
JAVA_SUFFIX = r"[dDfF]$"
INFINITY = r"inf$"


def clean(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(text), F.lit(""))


def typed(column: str | Column, logical: str) -> Column:
    text = clean(column)
    if logical == "int":
        exact = F.regexp_replace(text, SURPLUS, "$1").try_cast("decimal(38,18)")
        return F.when(text.rlike(NUMBER), F.coalesce(text.try_cast("bigint"), F.round(exact).try_cast("bigint")))
    if logical == "decimal":
        suffixed = text.rlike(JAVA_SUFFIX) & ~F.lower(text).rlike(INFINITY)
        return F.when(~suffixed, text.try_cast("double"))
    if logical == "date":
        dashed = F.replace(text, F.lit("/"), F.lit("-"))
        return F.when(text.rlike(FULL_DATE), dashed.try_cast("date"))
    if logical == "char":
        return text
    raise ValueError(f"unknown logical type: {logical}")


def cast_failed(column: str, logical: str) -> Column:
    """True where a value is present but unreadable; never NULL."""
    return clean(column).isNotNull() & typed(column, logical).isNull()


def failed_names(schema: PanelSchema) -> Column:
    """``a;b`` list of the columns that failed, from ``<col>_cast_failed``."""
    hits = [F.when(F.col(f"{n}_cast_failed"), F.lit(n)) for n, _ in schema.castable]
    return F.concat_ws(";", *hits)
