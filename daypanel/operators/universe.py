"""Ready base, terminal events, and the point-in-time tradable universe.

Nothing here looks past day t: windows end at the current row and ranks stay
within a day.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.derived import add_derived, dollar_volume
from daypanel.functions.quality import ACTIVE, add_quality_flags
from daypanel.operators.keys import dedup_first
from daypanel.operators.ordering import HOT_ROWS, add_row_number, keep_top
from daypanel.schema import DEFAULT_KEY, STANDARD_NAMES, Names, PanelKey

# ---- fixed values: flags a row of the ready base must have ----
READY = {
    "is_active_trading_flag": 1,
    "non_tradable_status_flag": 0,
    "terminal_event_flag": 0,
    "invalid_price_flag": 0,
    "invalid_volume_flag": 0,
    "invalid_market_cap_flag": 0,
    "return_missing_flag": 0,
    "security_metadata_missing_flag": 0,
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class UniverseParams:
    """Who may trade, and how liquid, large and old a security must be."""

    exchanges: tuple[str, ...] = ("N", "Q", "A")
    min_price: float = 5.0
    min_adv20: float = 1_000_000.0
    min_history_obs: int = 126
    max_market_cap_rank: int = 3000
    max_adv20_rank: int = 4000
    average_rows: int = 20
    history_rows: int = 252
    adv_digits: int | None = None

    def stamp(self) -> dict:
        """The parameters as constant columns of the result."""
        return {
            "in_universe_flag": F.lit(1),
            "universe_exchange_set": F.lit(",".join(self.exchanges)),
            "universe_min_price": F.lit(self.min_price),
            "universe_min_adv20": F.lit(self.min_adv20),
            "universe_min_history_obs": F.lit(self.min_history_obs),
            "universe_max_market_cap_rank": F.lit(self.max_market_cap_rank),
            "universe_max_adv20_rank": F.lit(self.max_adv20_rank),
        }


DEFAULT_PARAMS = UniverseParams()


def prepare_all(core: DataFrame, names: Names = STANDARD_NAMES) -> DataFrame:
    """All rows with the quality flags and derived variables."""
    return add_derived(add_quality_flags(core, names=names), names)


def is_ready(names: Names = STANDARD_NAMES) -> Column:
    """What the READY flags say together, as plain comparisons that a Parquet
    scan can use. An active status rules out the halted and delisted ones, and
    a positive price a settlement at zero."""
    c = names
    return (
        (c("tradingstatusflg") == ACTIVE)
        & ~c("dlydelflg").eqNullSafe("Y")
        & (c("prc") > 0)
        & (c("dlyvol") > 0)
        & (c("dlycap") > 0)
        & c("dlyret").isNotNull()
        & c("securitytype").isNotNull()
        & c("sharetype").isNotNull()
        & (c("shrout") > 0)
    )


def ready_rows(core: DataFrame, key: PanelKey = DEFAULT_KEY, names: Names = STANDARD_NAMES) -> DataFrame:
    """Tradable rows, one per security and day, with the number they replace."""
    return dedup_first(core.filter(is_ready(names)), key, count_as="n_rows_same_stock_day")


def ready_base(core: DataFrame, key: PanelKey = DEFAULT_KEY, names: Names = STANDARD_NAMES) -> DataFrame:
    """The ready rows with flags and derived variables. These depend on their
    own row alone, so they are added after the shuffle that finds the first row
    of a key and not carried through it."""
    return prepare_all(ready_rows(core, key, names), names)


def terminal_events(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("terminal_event_flag") == 1)


def common_equity(
    base: DataFrame, params: UniverseParams = DEFAULT_PARAMS, names: Names = STANDARD_NAMES
) -> DataFrame:
    return base.filter(common_equity_condition(params, names))


def common_equity_condition(params: UniverseParams = DEFAULT_PARAMS, names: Names = STANDARD_NAMES) -> Column:
    c = names
    return (
        (c("securitytype") == "EQTY")
        & (c("securitysubtype") == "COM")
        & (c("sharetype") == "NS")
        & (c("usincflg") == "Y")
        & (c("shradrflg") == "N")
        & c("primaryexch").isin(*params.exchanges)
    )


def add_history(
    candidates: DataFrame,
    params: UniverseParams = DEFAULT_PARAMS,
    key: PanelKey = DEFAULT_KEY,
    names: Names = STANDARD_NAMES,
) -> DataFrame:
    """Trailing averages and observation counts over the rows of a security.

    (entity, date) must be unique: a security then has at most one row per
    calendar day, which bounds the partitions of these windows. The count over
    the last 252 rows is the running count less the running count 252 rows
    earlier: constant work per row where a sliding frame would do 252 steps.
    """
    key.check_date(candidates)
    series = Window.partitionBy(key.entity).orderBy(key.date)
    recent = series.rowsBetween(-(params.average_rows - 1), 0)
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    with_windows = candidates.withColumn("dollar_volume_for_universe", dollar_volume(names)).withColumns(
        {
            "adv20": F.avg("dollar_volume_for_universe").over(recent),
            "avg_volume_20d": F.avg(names("dlyvol")).over(recent),
            "_ret_obs": F.count(names("dlyret")).over(upto),
            "trading_age_obs": F.count(F.lit(1)).over(upto),
        }
    )
    earlier = F.lag("_ret_obs", params.history_rows, 0).over(series)
    return with_windows.select(
        *candidates.columns,
        "dollar_volume_for_universe",
        "adv20",
        "avg_volume_20d",
        (F.col("_ret_obs") - earlier).alias("hist_ret_obs_252"),
        "trading_age_obs",
    )


def adv_order(params: UniverseParams = DEFAULT_PARAMS) -> Column:
    """Average volumes as they are ranked: as they are, or to a number of
    digits, so that the order of equal averages does not hang on float noise."""
    return F.col("adv20") if params.adv_digits is None else F.round("adv20", params.adv_digits)


def add_ranks(
    history: DataFrame,
    key: PanelKey = DEFAULT_KEY,
    names: Names = STANDARD_NAMES,
    hot_rows: int = HOT_ROWS,
    params: UniverseParams = DEFAULT_PARAMS,
) -> DataFrame:
    """Both cross-sectional ranks of every row and the size of its day."""
    key.check_date(history)
    sizes = history.groupBy(key.date).agg(F.count("*").alias("_n"))  # at most one row per calendar day
    with_orders = history.withColumns({"_cap": names("dlycap"), "_adv": adv_order(params)})
    by_cap = add_row_number(with_orders, key.date, "_cap", key.entity, "market_cap_rank", hot_rows, sizes=sizes)
    by_adv = add_row_number(by_cap, key.date, "_adv", key.entity, "adv20_rank", hot_rows, sizes=sizes)
    counted = by_adv.drop("_cap", "_adv").join(F.broadcast(sizes), key.date)
    return counted.withColumnRenamed("_n", "n_common_equity_candidates")


def universe_keys(
    history: DataFrame,
    params: UniverseParams = DEFAULT_PARAMS,
    key: PanelKey = DEFAULT_KEY,
    names: Names = STANDARD_NAMES,
) -> DataFrame:
    """Keys, history and ranks of the rows that pass every threshold.

    Ranks run over all candidates of a day, thresholds come after.
    """
    ranked = keep_top(
        history,
        key.date,
        {
            "market_cap_rank": (names("dlycap"), params.max_market_cap_rank),
            "adv20_rank": (adv_order(params), params.max_adv20_rank),
        },
        key.entity,
        count_as="n_common_equity_candidates",
    )
    return ranked.filter(
        (names("prc") >= params.min_price)
        & (F.col("adv20") >= params.min_adv20)
        & (F.col("hist_ret_obs_252") >= params.min_history_obs)
    )


def daily_universe(
    base: DataFrame,
    params: UniverseParams = DEFAULT_PARAMS,
    key: PanelKey = DEFAULT_KEY,
    names: Names = STANDARD_NAMES,
) -> DataFrame:
    """The universe of each day, with its ranks and the parameters stamped on.

    Windows and ranks run on a handful of columns; the wide rows are joined to
    the surviving keys once.
    """
    candidates = common_equity(base, params, names)
    standard = ("prc", "dlyvol", "dlycap", "dlyret")
    narrow = candidates.select(*key.pair, *[names(c) for c in standard])
    keys = universe_keys(add_history(narrow, params, key, names), params, key, names)
    added = [c for c in keys.columns if c not in narrow.columns]
    # The thresholds that need no history are filters of the wide side too, and so reach its scan.
    wide = candidates.filter(names("prc") >= params.min_price)
    return wide.join(keys.select(*key.pair, *added), key.pair).withColumns(params.stamp())


def universe_of_rows(
    core: DataFrame,
    params: UniverseParams = DEFAULT_PARAMS,
    key: PanelKey = DEFAULT_KEY,
    names: Names = STANDARD_NAMES,
    count_as: str | None = "n_rows_same_stock_day",
) -> DataFrame:
    """``daily_universe`` of the ``ready_rows`` of a table that is not stored by
    day yet.

    First rows are found among a few columns; of whole rows only such as pass
    the thresholds that need no history are dealt out. Where the first row of a
    key is in the universe it passes these, so it is the first of those that do.
    Rows alike in key and order stand in the order of the values that decide, so
    both sides mean the same row. The rows of a key are counted only where
    ``count_as`` names a column for them.
    """
    standard = [names(c) for c in ("prc", "dlyvol", "dlycap", "dlyret")]
    ready = core.filter(is_ready(names))
    decisive = PanelKey(key.entity, key.date, (*key.order, *core.select(*standard).columns, "_common"))
    # A condition that is not known is not met.
    common = F.coalesce(common_equity_condition(params, names), F.lit(False))
    first = dedup_first(ready.select(*key.pair, *key.order, *standard, common.alias("_common")), decisive)
    narrow = first.filter("_common").select(*key.pair, *standard)
    keys = universe_keys(add_history(narrow, params, key, names), params, key, names)
    added = [c for c in keys.columns if c not in narrow.columns]
    found = keys.select(*key.pair, *added)
    if count_as is not None:
        found = found.join(ready.groupBy(*key.pair).agg(F.count("*").alias(count_as)), key.pair)
    wide = common_equity(ready, params, names).filter(names("prc") >= params.min_price)
    rows = dedup_first(wide.join(found, key.pair), replace(decisive, order=decisive.order[:-1]))
    return rows.select(*core.columns, *([count_as] if count_as else []), *added).withColumns(params.stamp())
