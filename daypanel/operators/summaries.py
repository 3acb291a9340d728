"""Reports on the finished stages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.operators.distinct import distinct_ids, distinct_pairs, has_bitmaps, id_bitmaps
from daypanel.operators.examples import listing
from daypanel.operators.groups import value_counts
from daypanel.operators.labels import DEFAULT_LABELS, LabelParams
from daypanel.operators.ordering import column_quantiles, exact_quantiles, head
from daypanel.schema import DEFAULT_KEY, PanelKey

# ---- fixed values: preview columns and labels ----
BASE_PREVIEW = (
    "dlycaldt", "permno", "ticker", "primaryexch", "securitytype", "sharetype", "tradingstatusflg", "prc",
    "dlyvol", "dlycap", "dlyret", "has_ohlc_flag", "ohlc_missing_flag", "price_from_bidask_flag",
    "bidask_missing_flag", "dollar_volume",
)
UNIVERSE_PREVIEW = (
    "dlycaldt", "permno", "ticker", "primaryexch", "securitytype", "securitysubtype", "sharetype", "prc",
    "dlyvol", "dlycap", "adv20", "market_cap_rank", "adv20_rank", "hist_ret_obs_252", "has_ohlc_flag",
    "price_from_bidask_flag", "bidask_missing_flag",
)
NO_MISSING_LABEL = "__NO_MISSING__"
NULL_LABEL = "__NULL__"
# ---- end of fixed values ----


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def latest_rows(df: DataFrame, columns, n: int, second: str, date: str = "dlycaldt", entity: str = "permno"):
    """The last days first, then by the second column; ``n`` rows."""
    order = [F.desc_nulls_last(date), F.asc_nulls_last(second), F.asc_nulls_last(entity)]
    rows = df if columns is None else df.select(*[c for c in columns if c in df.columns])
    return head(rows.orderBy(*order), n)


def stage_row_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def universe_daily_summary(universe: DataFrame, date: str = "dlycaldt") -> DataFrame:
    """Size, medians and ranks per day, for days of any size."""
    sizes = universe.groupBy(date, "year").agg(
        F.count("*").alias("n_universe"),
        F.min("prc").alias("min_prc"),
        F.min("market_cap_rank").alias("best_market_cap_rank"),
        F.max("market_cap_rank").alias("worst_market_cap_rank"),
        F.min("adv20_rank").alias("best_adv20_rank"),
        F.max("adv20_rank").alias("worst_adv20_rank"),
    )
    medians = {"median_prc": ("prc", 0.5), "median_mktcap": ("dlycap", 0.5), "median_adv20": ("adv20", 0.5)}
    return _with_days(sizes, universe, medians, date).select(
        date, "year", "n_universe", "min_prc", *medians,
        "best_market_cap_rank", "worst_market_cap_rank", "best_adv20_rank", "worst_adv20_rank",
    ).orderBy(date)


def _with_days(sizes: DataFrame, rows: DataFrame, wanted: dict[str, tuple[str, float]], date: str) -> DataFrame:
    """Aggregates of days with exact quantiles of their rows beside them."""
    found = column_quantiles(rows, [date, "year"], wanted, few_groups=True).withColumnsRenamed({date: "_date", "year": "_year"})
    same = F.col(date).eqNullSafe(F.col("_date")) & F.col("year").eqNullSafe(F.col("_year"))
    return sizes.join(found, same, "left").drop("_date", "_year")


def universe_yearly_summary(universe: DataFrame, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """Days, sizes and names of a year. One pass over the rows makes a line per
    day and range of ids; everything else adds those up."""
    if has_bitmaps(universe, key.entity):
        parts = id_bitmaps(universe, ["year", key.date], key.entity, n=F.count("*"))
        daily = parts.groupBy("year", key.date).agg(F.sum("n").alias("n_daily"))
        names = distinct_ids(parts, ["year"], "n_unique_permnos")
    else:
        daily = universe.groupBy("year", key.date).agg(F.count("*").alias("n_daily"))
        names = universe.groupBy("year").agg(F.count_distinct(key.entity).alias("n_unique_permnos"))
    n = F.col("n_daily")
    sizes = daily.groupBy("year").agg(
        F.sum(n).alias("n_rows"),
        F.count("*").alias("n_days"),
        F.avg(n).alias("avg_daily_universe_size"),
        F.min(n).alias("min_daily_universe_size"),
        F.max(n).alias("max_daily_universe_size"),
    )
    return _by_year(sizes, names)


def _by_year(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Aggregates of years side by side; every year of the first stays, and the
    rows without a year are one more."""
    for other in others:
        renamed = other.withColumnRenamed("year", "_year")
        first = first.join(renamed, F.col("year").eqNullSafe(F.col("_year")), "left").drop("_year")
    return first.orderBy("year")


def missing_return_summary(core: DataFrame) -> DataFrame:
    gone, flagged = F.col("dlyret").isNull(), F.col("dlyretmissflg").isNotNull()
    return core.agg(
        F.count("*").alias("n_total"),
        F.count_if(gone).alias("n_missing_dlyret"),
        F.count_if(gone & flagged).alias("n_missing_dlyret_with_dlyretmissflg"),
        F.count_if(gone & ~flagged).alias("n_missing_dlyret_without_dlyretmissflg"),
        share(gone).alias("missing_dlyret_rate"),
    )


def missing_return_status(core: DataFrame, with_flag: bool) -> DataFrame:
    flagged = F.col("dlyretmissflg").isNotNull()
    where = F.col("dlyret").isNull() & (flagged if with_flag else ~flagged)
    return value_counts(core, "tradingstatusflg", where, as_name="tradingstatusflg")


def missing_return_flags(core: DataFrame) -> DataFrame:
    return value_counts(core, "dlyretmissflg", F.col("dlyret").isNull(), NULL_LABEL, "dlyretmissflg")


def retained_return_flags(universe: DataFrame) -> DataFrame:
    return value_counts(universe, "dlyretmissflg", F.col("dlyretmissflg").isNotNull(), as_name="dlyretmissflg")


def retained_return_flag_rows(universe: DataFrame) -> DataFrame:
    return listing(universe, F.col("dlyretmissflg").isNotNull())


def _label_measures(params: LabelParams) -> dict[str, Column]:
    complete = F.col(params.complete).isNull()
    h = params.horizon
    return {
        f"n_missing_target_{h}d_complete": F.count_if(complete),
        f"missing_target_{h}d_complete_rate": share(complete),
        "n_has_missing_forward_return": F.sum("target_has_missing_return"),
        "has_missing_forward_return_rate": F.avg("target_has_missing_return"),
        "n_has_delisting_missing_flag": F.sum("target_has_delisting_missing_flag"),
        "has_delisting_missing_flag_rate": F.avg("target_has_delisting_missing_flag"),
    }


def label_summary(labels: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    one_day = F.col("target_1d_raw").isNull()
    measures = [c.alias(n) for n, c in _label_measures(params).items()]
    by_bits = has_bitmaps(labels, key.entity)
    pairs = [] if by_bits else [F.count_distinct(*key.pair).alias("n_unique_stock_days")]
    found = labels.agg(
        F.count("*").alias("n_rows"), *pairs, F.count_if(one_day).alias("n_missing_target_1d_raw"),
        share(one_day).alias("missing_target_1d_rate"), *measures,
    )
    if by_bits:
        days = id_bitmaps(labels, [key.date], key.entity)
        found = found.withColumn("n_unique_stock_days", distinct_pairs(days, [key.date]))
    rest = [c for c in found.columns if c not in ("n_rows", "n_unique_stock_days")]
    return found.select("n_rows", "n_unique_stock_days", *rest)


def label_yearly_summary(labels: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    measures = [c.alias(n) for n, c in _label_measures(params).items()]
    return labels.groupBy("year").agg(F.count("*").alias("n_rows"), *measures).orderBy("year")


def label_flag_counts(labels: DataFrame, column: str) -> DataFrame:
    return value_counts(labels, column, null_label=NO_MISSING_LABEL, as_name=column)


def missing_label_examples(labels: DataFrame, n: int | None = 200) -> DataFrame:
    return head(listing(labels, F.col("target_has_missing_return") == 1), n)


def panel_coverage_summary(joined: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    gone = F.col(params.complete).isNull()
    h = params.horizon
    return joined.agg(
        F.count("*").alias("n_universe_rows"),
        F.count(params.complete).alias("n_complete_label_rows"),
        F.count_if(gone).alias(f"n_rows_dropped_missing_complete_{h}d_label"),
        share(gone).alias(f"missing_complete_{h}d_label_rate"),
    )


def panel_daily_summary(panel: DataFrame, params: LabelParams = DEFAULT_LABELS, date: str = "dlycaldt") -> DataFrame:
    """Per day, for days of any size."""
    t, raw = f"target_{params.horizon}d", params.complete
    sizes = panel.groupBy(date, "year").agg(
        F.count("*").alias("n_model_rows"),
        F.avg(raw).alias(f"mean_{t}_raw"),
        F.avg(f"{t}_cs_zscore").alias(f"mean_{t}_cs_zscore"),
        F.stddev_samp(f"{t}_cs_zscore").alias(f"sd_{t}_cs_zscore"),
    )
    spread = {f"{t}_p01": (raw, 0.01), f"{t}_p50": (raw, 0.50), f"{t}_p99": (raw, 0.99)}
    # The panel has limits of its own by these names; here they are those of its days as they stand.
    found = _with_days(sizes, panel.select(date, "year", raw), spread, date)
    return found.select(
        date, "year", "n_model_rows", *spread, f"mean_{t}_raw", f"mean_{t}_cs_zscore", f"sd_{t}_cs_zscore"
    ).orderBy(date)


def panel_yearly_summary(
    panel: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY
) -> DataFrame:
    t, raw = f"target_{params.horizon}d", params.complete
    sizes = panel.groupBy("year").agg(
        F.count("*").alias("n_rows"),
        F.avg(raw).alias(f"mean_{t}_raw"),
        F.avg(f"{t}_cs_zscore").alias(f"mean_{t}_cs_zscore"),
        F.stddev_samp(f"{t}_cs_zscore").alias(f"sd_{t}_cs_zscore"),
    )
    if has_bitmaps(panel, key.entity):
        parts = id_bitmaps(panel, ["year", key.date], key.entity)
        days = parts.groupBy("year", key.date).agg(F.lit(1).alias("_one")).groupBy("year").agg(F.count(key.date).alias("n_days"))
        names = distinct_ids(parts, ["year"], "n_unique_permnos")
    else:
        days = panel.groupBy("year").agg(F.count_distinct(key.date).alias("n_days"))
        names = panel.groupBy("year").agg(F.count_distinct(key.entity).alias("n_unique_permnos"))
    medians = exact_quantiles(panel, ["year"], raw, {f"median_{t}_raw": 0.5}, few_groups=True)
    return _by_year(sizes, days, names, medians)


def recent_label_availability(
    joined: DataFrame, n: int | None = 15, params: LabelParams = DEFAULT_LABELS, date: str = "dlycaldt"
) -> DataFrame:
    gone = F.col(params.complete).isNull()
    h = params.horizon
    days = (
        joined.groupBy(date)
        .agg(
            F.count("*").alias("n_universe_rows"),
            F.count_if(gone).alias(f"n_missing_complete_{h}d_label"),
            share(gone).alias(f"missing_complete_{h}d_label_rate"),
        )
        .orderBy(F.desc_nulls_last(date))
    )
    return head(days, n)


def dropped_label_examples(joined: DataFrame, n: int | None = 500, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    return latest_rows(joined.filter(F.col(params.complete).isNull()), None, n, "permno")
