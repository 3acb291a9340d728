"""Rows worth reading: samples of a condition, listings and edge cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.quality import ohlc_absent, ohlc_disagrees
from daypanel.functions.rules import CORE_RULES, column_rule
from daypanel.operators.groups import regular_rows
from daypanel.operators.ordering import head
from daypanel.schema import DEFAULT_KEY, STANDARD_NAMES, Names, PanelKey, require_columns

SEED = 9527

# ---- fixed values: columns of the short listings ----
OHLC_LISTING = (
    "dlycaldt", "permno", "ticker", "dlyopen", "dlyhigh", "dlylow", "dlyclose",
    "dlyprc", "prc", "dlyprcflg", "dlyvol", "dlyret",
)
QUOTE_LISTING = (
    "dlycaldt", "permno", "ticker", "dlybid", "dlyask", "dlyprc", "prc",
    "dlyprcflg", "dlyvol", "dlyret", "bid_ask_spread",
)
# ---- end of fixed values ----


def draw_order(key: PanelKey = DEFAULT_KEY, seed: int = SEED) -> Column:
    """A repeatable shuffle of rows: a hash of the row's key and a seed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*key.pair, *key.order]]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def sample_rows(
    df: DataFrame, condition: Column, n: int = 20, seed: int = SEED, key: PanelKey = DEFAULT_KEY
) -> DataFrame:
    """All rows that meet a condition if there are at most ``n``, else ``n`` of
    them at random, in key order. Every task keeps its best ``n`` rows."""
    drawn = df.filter(condition).orderBy(draw_order(key, seed))
    drawn = head(drawn, n)
    return drawn.orderBy(*[F.asc_nulls_last(c) for c in [key.date, key.entity, *key.order]])


def missing_examples(df: DataFrame, variable: str, n: int = 20, seed: int = SEED) -> DataFrame:
    require_columns(df, [variable])
    return sample_rows(df, F.col(variable).isNull(), n, seed)


def nonmissing_examples(df: DataFrame, variable: str, n: int = 20, seed: int = SEED) -> DataFrame:
    """From the regular rows."""
    require_columns(df, [variable])
    return sample_rows(regular_rows(df), F.col(variable).isNotNull(), n, seed)


def abnormal_rows(
    df: DataFrame, variable: str, n: int = 20, predicate: str | None = None, seed: int = SEED, registry=CORE_RULES
) -> DataFrame:
    """By the registered rule of the variable or by the caller's own, which is
    analysed before anything runs."""
    require_columns(df, [variable])
    rule = column_rule(variable, predicate, registry, df)
    require_columns(df, rule.columns)
    return sample_rows(df, rule.hit(), n, seed)


def matches(df: DataFrame, condition: Column, n: int = 20) -> DataFrame:
    """How many rows meet a condition, of how many, and whether ``n`` examples
    of them are all or a draw; one row."""
    met = F.count_if(F.coalesce(condition, F.lit(False)))
    return df.agg(met.alias("n_matching"), F.count("*").alias("n_total"), F.least(met, F.lit(n)).alias("n_shown"), (met > n).alias("drawn"))


def listing(df: DataFrame, condition: Column, columns: Sequence[str] | None = None, key: PanelKey = DEFAULT_KEY):
    """All rows that meet a condition, by date and entity."""
    rows = df.filter(condition)
    if columns is not None:
        rows = rows.select(*[c for c in columns if c in df.columns])
    return rows.orderBy(F.asc_nulls_last(key.date), F.asc_nulls_last(key.entity))


def return_without_flag(c: Names = STANDARD_NAMES) -> Column:
    return c("dlyret").isNull() & c("dlyretmissflg").isNull()


def open_only_missing(c: Names = STANDARD_NAMES) -> Column:
    rest = c("dlyclose").isNotNull() & c("dlyhigh").isNotNull() & c("dlylow").isNotNull()
    return c("dlyopen").isNull() & rest


def quote_missing(c: Names = STANDARD_NAMES) -> Column:
    return c("dlybid").isNull() | c("dlyask").isNull()


def quote_invalid(c: Names = STANDARD_NAMES) -> Column:
    return c("bid_ask_spread").isNull() & ~quote_missing(c)


def ohlc_inconsistent_rows(df: DataFrame) -> DataFrame:
    return listing(df, ohlc_disagrees(STANDARD_NAMES), OHLC_LISTING)


def ohlc_missing_sample(df: DataFrame, n: int = 50, seed: int = SEED) -> DataFrame:
    return sample_rows(df, ohlc_absent(STANDARD_NAMES), n, seed)


def invalid_quote_rows(df: DataFrame, n: int | None = 100) -> DataFrame:
    return head(listing(df, quote_invalid(), QUOTE_LISTING), n)


def spread_missing_reasons(df: DataFrame, c: Names = STANDARD_NAMES) -> DataFrame:
    """Rows without a spread by the first reason that applies."""
    bid, ask = c("dlybid"), c("dlyask")
    reason = (
        F.when(quote_missing(c), "bid_or_ask_missing")
        .when(bid <= 0, "bid_nonpositive")
        .when(ask <= 0, "ask_nonpositive")
        .when(ask < bid, "ask_less_than_bid")
        .otherwise("other")
    )
    counts = df.filter(c("bid_ask_spread").isNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), "reason")


def ohlc_missing_by_price_flag(df: DataFrame) -> DataFrame:
    names = ("open", "close", "high", "low")
    counts = [F.count_if(F.col(f"dly{x}").isNull()).alias(f"n_missing_{x}") for x in names]
    return (
        df.groupBy("dlyprcflg", "price_from_bidask_flag")
        .agg(F.count("*").alias("n_rows"), *counts)
        .filter(F.greatest(*[F.col(f"n_missing_{x}") for x in names]) > 0)
        .withColumn("close_missing_rate", F.col("n_missing_close") / F.col("n_rows"))
        .orderBy(F.desc("n_missing_close"), F.asc_nulls_last("dlyprcflg"))
    )
