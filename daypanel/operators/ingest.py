"""Typed table, cast diagnostics and quarantine from an all-text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.casting import cast_failed, failed_names, typed
from daypanel.functions.quality import any_of
from daypanel.operators.ordering import head
from daypanel.schema import DAILY_STOCK, DEFAULT_KEY, PanelKey, PanelSchema, require_columns


#: the column that holds the text of a record of a wrong length, see ``read_raw_csv``
BAD_RECORD = "bad_record"
RECORD_FAULT = "record_fault"
# What is not a comma between fields: text in quotes, where a quote is doubled.
QUOTED = '"([^"]|"")*"'


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def add_cast_flags(raw: DataFrame, schema: PanelSchema = DAILY_STOCK) -> DataFrame:
    """``<col>_cast_failed`` for every variable whose cast can fail."""
    require_columns(raw, schema.names)
    return raw.withColumns({f"{n}_cast_failed": cast_failed(n, t) for n, t in schema.castable})


def add_failed_columns(raw: DataFrame, schema: PanelSchema = DAILY_STOCK) -> DataFrame:
    """The flags plus ``failed_columns``, an ``a;b`` list, '' for a clean row."""
    return add_cast_flags(raw, schema).withColumn("failed_columns", failed_names(schema))


def record_fault(raw: DataFrame, record: str = BAD_RECORD) -> Column:
    """Why a record is not one of the table: ``too_few_fields``, ``too_many_fields``
    or, for what else the reader refused, ``unreadable``; NULL for the others."""
    if record not in raw.columns:
        return F.lit(None).cast("string")
    expected = len([c for c in raw.columns if c not in (record, "source_file", "raw_row_id")])
    text = F.col(record)
    bare = F.regexp_replace(text, QUOTED, "")
    fields = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","))) + 1
    few, many = F.when(fields < expected, "too_few_fields"), F.when(fields > expected, "too_many_fields")
    fault = F.coalesce(few, many, F.lit("unreadable"))
    return F.when(text.isNotNull(), fault)


def readable(raw: DataFrame, record: str = BAD_RECORD) -> DataFrame:
    """Rows whose values belong to their columns. A record that ends early has
    NULL in the columns it lacks and stays; in one with too many fields no value
    is sure of its column."""
    if record not in raw.columns:
        return raw
    fault = record_fault(raw, record)
    return raw.filter(fault.isNull() | (fault == "too_few_fields")).drop(record)


def quarantine(raw: DataFrame, schema: PanelSchema = DAILY_STOCK) -> DataFrame:
    """Rows with at least one failed cast or of a wrong length, as raw text and
    with the flags. Where the reader kept the text of bad records, it stands
    beside what is wrong with it."""
    failed = any_of(F.col(f"{n}_cast_failed") for n, _ in schema.castable)
    flagged = add_failed_columns(raw, schema)
    if BAD_RECORD not in raw.columns:
        return flagged.filter(failed)
    return flagged.withColumn(RECORD_FAULT, record_fault(raw)).filter(failed | F.col(BAD_RECORD).isNotNull())


def quarantine_sample(quarantined: DataFrame, n: int = 200, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    order = list(key.order)
    fault = [RECORD_FAULT] if RECORD_FAULT in quarantined.columns else []
    return head(quarantined.select(*order, "failed_columns", *fault).orderBy(*order), n)


def apply_types(raw: DataFrame, schema: PanelSchema = DAILY_STOCK) -> DataFrame:
    """Cast every variable; columns outside the dictionary pass through."""
    require_columns(raw, schema.names)
    return raw.withColumns({n: typed(n, t) for n, t in schema})


def add_price_columns(df: DataFrame, date: str = "dlycaldt", price: str = "dlyprc") -> DataFrame:
    """``year``; the sign of the price as a three-valued flag; its magnitude.

    A negative price marks a bid/ask average in the source, so ``prc`` is the
    value to work with and the raw price stays as it is.
    """
    return df.withColumns(
        {
            "year": F.year(date),
            "dlyprc_negative_flag": F.col(price) < 0,
            "prc": F.abs(price),
        }
    )


def daily_core(raw: DataFrame, schema: PanelSchema = DAILY_STOCK) -> DataFrame:
    return add_price_columns(apply_types(readable(raw), schema))


def without_key(df: DataFrame, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """Rows that lack part of their key; they belong to no series or day."""
    return df.filter(any_of(F.col(c).isNull() for c in key.pair))
