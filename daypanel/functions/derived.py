"""Row-local derived variables; NULL unless the guard of the formula holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.quality import OHLC, ohlc_disagrees, ohlc_from_quote, ohlc_present, quotes_valid
from daypanel.schema import STANDARD_NAMES, Names


def log_of(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log_count(n: Column) -> Column:
    # log1p would differ from ln(1 + n) in the last bit.
    return F.when(n >= 0, F.ln(F.lit(1) + n))


def dollar_volume(c: Names) -> Column:
    return F.when((c("prc") > 0) & (c("dlyvol") > 0), c("prc") * c("dlyvol"))


def relative_spread(c: Names) -> Column:
    bid, ask = c("dlybid"), c("dlyask")
    return F.when(quotes_valid(c), (ask - bid) / ((ask + bid) / 2.0))


def growth(end: Column, start: Column) -> Column:
    return F.when((start > 0) & (end > 0), end / start - 1)


def range_width(high: Column, low: Column) -> Column:
    return F.when((high > 0) & (low > 0) & (high >= low), high / low - 1)


def add_derived(df: DataFrame, names: Names = STANDARD_NAMES) -> DataFrame:
    """Append the 14 derived variables of the prepared table."""
    c = names
    o, h, l, x = (c(name) for name in OHLC)
    stand_in = F.when(ohlc_from_quote(c), c("prc"))
    df = df.withColumns({f"{name}_clean": F.coalesce(c(name), stand_in) for name in OHLC})
    return df.withColumns(
        {
            "log_prc": log_of(c("prc")),
            "log_dlycap": log_of(c("dlycap")),
            "dollar_volume": dollar_volume(c),
            "bid_ask_spread": relative_spread(c),
            "log_num_trades": log_count(c("dlynumtrd")),
            "log_market_maker_count": log_count(c("dlymmcnt")),
            "intraday_ret_strict": growth(x, o),
            "intraday_range_strict": range_width(h, l),
            "intraday_ret_clean": growth(F.col("dlyclose_clean"), F.col("dlyopen_clean")),
            "intraday_range_clean": range_width(F.col("dlyhigh_clean"), F.col("dlylow_clean")),
        }
    )


def add_ohlc_features(df: DataFrame, names: Names = STANDARD_NAMES) -> DataFrame:
    """Intraday features kept only where OHLC is complete and consistent."""
    o, h, l, x = (names(name) for name in OHLC)
    usable = ohlc_present(names) & ~ohlc_disagrees(names)
    return df.withColumns(
        {
            "ohlc_usable_flag": F.when(usable, 1).otherwise(0),
            "intraday_ret_valid": F.when(usable, growth(x, o)),
            "intraday_range_valid": F.when(usable, range_width(h, l)),
        }
    )


def add_distribution_features(df: DataFrame, names: Names = STANDARD_NAMES) -> DataFrame:
    """Distribution amount scaled by price, and the size of price factors."""
    c = names
    return df.withColumns(
        {
            "distribution_yield": F.when(c("prc") > 0, c("disdivamt") / c("prc")),
            "split_event_flag": F.when(c("disfacpr").isNotNull() & (c("disfacpr") != 0), 1).otherwise(0),
            "abs_disfacpr": F.abs(c("disfacpr")),
        }
    )


def distribution_kind(names: Names = STANDARD_NAMES) -> Column:
    """Name the event of a row: adjustments stay apart from dividends, and an
    ordinary dividend needs a positive amount on an ordinary row."""
    c = names
    amount, ordinary = c("disdivamt"), c("disordinaryflg") == "Y"
    is_event = F.coalesce(c("distype"), c("disdetailtype")).isNotNull() | amount.isNotNull()
    adjusts = (amount < 0) | (c("disfacpr") < 0)
    stock = (c("disfacshr") != 0) & amount.isNull()
    return (
        F.when(~is_event, "none")
        .when(adjusts, "adjustment")
        .when(ordinary & (amount > 0), "ordinary_cash")
        .when(amount > 0, "special_cash")
        .when(stock, "stock")
        .otherwise("other")
    )
