"""Row-quality flags: 0/1 integers that are never NULL.

A flag is 1 only where its condition is known to be true; an unknown (NULL)
condition counts as 0. Flags come in groups so that a caller can compute only
the group it needs; a flag may use columns of the table but no other flag.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.schema import STANDARD_NAMES, Names

# ---- fixed values: codes of the source file ----
ACTIVE = "A"
HALTED = ("X", "S", "H")
DELISTED = "D"
BID_ASK_PRICE = "BA"
DELISTING_PRICE = "DA"
HIGH_PRICE = 100000
RETURN_RANGE = (-1, 20)
OHLC = ("dlyopen", "dlyhigh", "dlylow", "dlyclose")
DISTRIBUTION = ("disexdt", "distype", "disdivamt", "disfacpr", "disfacshr")
# ---- end of fixed values ----


def all_of(conditions) -> Column:
    return reduce(and_, conditions)


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def ohlc_present(c: Names) -> Column:
    return all_of(c(x).isNotNull() for x in OHLC)


def ohlc_absent(c: Names) -> Column:
    return any_of(c(x).isNull() for x in OHLC)


def ohlc_disagrees(c: Names) -> Column:
    """High below low, or open or close outside [low, high]."""
    o, h, l, x = (c(name) for name in OHLC)
    return ohlc_present(c) & ((h < l) | ~o.between(l, h) | ~x.between(l, h))


def ohlc_from_quote(c: Names) -> Column:
    """Rows whose missing OHLC may be stood in for by the quote-based price."""
    return (
        ohlc_absent(c)
        & (c("prc") > 0)
        & (c("tradingstatusflg") == ACTIVE)
        & (c("dlyprcflg") == BID_ASK_PRICE)
    )


def quotes_valid(c: Names) -> Column:
    return (c("dlybid") > 0) & (c("dlyask") > 0) & (c("dlyask") >= c("dlybid"))


def absent_or_not_positive(column: Column) -> Column:
    return column.isNull() | (column <= 0)


def status_conditions(c: Names) -> dict[str, Column]:
    status, deleted = c("tradingstatusflg"), c("dlydelflg") == "Y"
    settled_at_zero = (c("prc") == 0) & (c("dlyprcflg") == DELISTING_PRICE)
    return {
        "is_active_trading_flag": status == ACTIVE,
        "non_tradable_status_flag": status.isin(*HALTED),
        "terminal_event_flag": (status == DELISTED) | deleted | settled_at_zero,
        "daily_delisting_flag": deleted,
    }


def price_conditions(c: Names) -> dict[str, Column]:
    return {
        "invalid_price_flag": absent_or_not_positive(c("prc")),
        "zero_price_flag": c("prc") == 0,
        "high_price_flag": c("prc") > HIGH_PRICE,
        "price_from_bidask_flag": c("dlyprcflg") == BID_ASK_PRICE,
        "negative_raw_price_flag": c("dlyprc_negative_flag"),
    }


def ohlc_conditions(c: Names) -> dict[str, Column]:
    return {
        "has_ohlc_flag": ohlc_present(c),
        "ohlc_missing_flag": ohlc_absent(c),
        "ohlc_inconsistent_flag": ohlc_disagrees(c),
        "ohlc_imputed_from_prc_flag": ohlc_from_quote(c),
    }


def quote_conditions(c: Names) -> dict[str, Column]:
    return {
        "bidask_missing_flag": c("dlybid").isNull() | c("dlyask").isNull(),
        "valid_bidask_flag": quotes_valid(c),
    }


def size_conditions(c: Names) -> dict[str, Column]:
    return {
        "invalid_volume_flag": absent_or_not_positive(c("dlyvol")),
        "invalid_market_cap_flag": absent_or_not_positive(c("dlycap")),
        "price_volume_missing_flag": c("dlyprcvol").isNull(),
    }


def return_conditions(c: Names) -> dict[str, Column]:
    low, high = RETURN_RANGE
    return {
        "return_missing_flag": c("dlyret").isNull(),
        "price_return_missing_flag": c("dlyretx").isNull(),
        "income_return_missing_flag": c("dlyreti").isNull(),
        "extreme_return_flag": ~c("dlyret").between(low, high),
    }


def meta_conditions(c: Names) -> dict[str, Column]:
    kind, share = c("securitytype"), c("sharetype")
    return {
        "security_metadata_missing_flag": (
            kind.isNull() | share.isNull() | absent_or_not_positive(c("shrout"))
        ),
        "is_equity_flag": kind == "EQTY",
        "is_fund_flag": kind == "FUND",
        "is_common_share_flag": share == "NS",
        "is_adr_flag": c("shradrflg") == "Y",
        "is_us_incorporated_flag": c("usincflg") == "Y",
        "num_trades_missing_flag": c("dlynumtrd").isNull(),
        "market_maker_count_missing_flag": c("dlymmcnt").isNull(),
        "exchange_tier_missing_flag": c("exchangetier").isNull(),
    }


def event_conditions(c: Names) -> dict[str, Column]:
    return {
        "has_delactiontype_flag": c("delactiontype").isNotNull(),
        "has_shareclass_flag": c("shareclass").isNotNull(),
        "has_distribution_event_flag": any_of(c(x).isNotNull() for x in DISTRIBUTION),
        "has_distribution_amount_flag": c("disdivamt").isNotNull(),
        "has_ordinary_distribution_flag": c("disordinaryflg") == "Y",
        "negative_disfacpr_flag": c("disfacpr") < 0,
        "negative_disfacshr_flag": c("disfacshr") < 0,
        "negative_disdivamt_flag": c("disdivamt") < 0,
        "price_adjustment_event_flag": c("dlyfacprc") != 1,
    }


FLAG_GROUPS = {
    "status": status_conditions,
    "price": price_conditions,
    "ohlc": ohlc_conditions,
    "quote": quote_conditions,
    "size": size_conditions,
    "return": return_conditions,
    "meta": meta_conditions,
    "event": event_conditions,
}


def flag_columns(group: str, names: Names = STANDARD_NAMES) -> dict[str, Column]:
    return {name: flag(cond) for name, cond in FLAG_GROUPS[group](names).items()}


def add_quality_flags(df: DataFrame, groups=None, names: Names = STANDARD_NAMES) -> DataFrame:
    """Append the flags of the named groups (all groups by default)."""
    flags: dict[str, Column] = {}
    for group in groups or FLAG_GROUPS:
        flags |= flag_columns(group, names)
    return df.withColumns(flags)
