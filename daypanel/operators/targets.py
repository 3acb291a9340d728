"""Panel of universe rows with labels normalised within each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.operators.labels import DEFAULT_LABELS, LabelParams, label_columns
from daypanel.operators.ordering import exact_quantiles
from daypanel.schema import DEFAULT_KEY, PanelKey

LOW, HIGH = 0.01, 0.99


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def standardise(x: Column, mean: Column, sd: Column) -> Column:
    """0 where the day has no spread; a day with one name has a NULL spread."""
    return F.when(sd.isNull() | (sd == 0), 0.0).otherwise((x - mean) / sd)


def winsorize_by(
    df: DataFrame,
    value: str,
    prefix: str,
    low: float = LOW,
    high: float = HIGH,
    key: PanelKey = DEFAULT_KEY,
) -> DataFrame:
    """Clip a value to its own day's quantiles, for days of any size.

    The quantiles are one row per calendar day, which bounds the broadcast.
    """
    key.check_date(df)
    names = {f"{prefix}_p01": low, f"{prefix}_p99": high}
    limits = exact_quantiles(df.filter(F.col(key.date).isNotNull()), [key.date], value, names, few_groups=True)
    bounded = df.join(F.broadcast(limits), key.date, "left")
    clipped = clip(F.col(value), F.col(f"{prefix}_p01"), F.col(f"{prefix}_p99"))
    return bounded.withColumn(f"{prefix}_winsor", clipped).select(*df.columns, *names, f"{prefix}_winsor")


def zscore_by(df: DataFrame, value: str, out: str, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """Standardise a value within its day, for days of any size."""
    key.check_date(df)
    stats = df.groupBy(key.date).agg(
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_samp(value).alias(f"{value}_sd"),
        F.count("*").alias("n_cross_section"),
    )
    scored = df.join(F.broadcast(stats), key.date, "left")
    z = standardise(F.col(value), F.col(f"{value}_mean"), F.col(f"{value}_sd"))
    return scored.withColumn(out, z).select(*df.columns, f"{value}_mean", f"{value}_sd", "n_cross_section", out)


def join_labels(
    universe: DataFrame, labels: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY
) -> DataFrame:
    """Universe rows with their labels, NULL where there are none."""
    return universe.join(labels.select(*key.pair, *label_columns(params)), key.pair, "left")


def complete_rows(joined: DataFrame, params: LabelParams = DEFAULT_LABELS) -> DataFrame:
    return joined.filter(F.col(params.complete).isNotNull())


def normalise_target(
    complete: DataFrame,
    params: LabelParams = DEFAULT_LABELS,
    key: PanelKey = DEFAULT_KEY,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Winsorised and standardised label. Both statistics of a day come from
    the date and the label alone, and the wide rows are joined to them once, so
    a day's wide rows are never gathered. ``narrow`` may pass in a stored table
    of these two columns where ``complete`` is costly to compute."""
    key.check_date(complete)
    t, value = f"target_{params.horizon}d", params.complete
    names = {f"{t}_p01": LOW, f"{t}_p99": HIGH}
    winsor = clip(F.col(value), F.col(f"{t}_p01"), F.col(f"{t}_p99"))
    narrow = (complete if narrow is None else narrow).select(key.date, value).filter(F.col(key.date).isNotNull())
    limits = exact_quantiles(narrow, [key.date], value, names, few_groups=True)
    days = (
        narrow.join(F.broadcast(limits), key.date, "left")
        .withColumn("_winsor", winsor)
        .groupBy(key.date, *names)
        .agg(
            F.avg("_winsor").alias(f"{t}_winsor_mean"),
            F.stddev_samp("_winsor").alias(f"{t}_winsor_sd"),
            F.count("*").alias("n_cross_section"),
        )
    )
    z = standardise(F.col(f"{t}_winsor"), F.col(f"{t}_winsor_mean"), F.col(f"{t}_winsor_sd"))
    added = [*names, f"{t}_winsor", f"{t}_winsor_mean", f"{t}_winsor_sd", "n_cross_section", f"{t}_cs_zscore"]
    with_days = complete.join(F.broadcast(days), key.date, "left").withColumn(f"{t}_winsor", winsor)
    return with_days.withColumn(f"{t}_cs_zscore", z).select(*complete.columns, *added)


def model_panel(
    universe: DataFrame, labels: DataFrame, params: LabelParams = DEFAULT_LABELS, key: PanelKey = DEFAULT_KEY
) -> DataFrame:
    """Stage tables of the universe and of the labels: their join is read for the
    statistics of days, by two columns, and for the rows themselves."""
    return normalise_target(complete_rows(join_labels(universe, labels, params, key), params), params, key)
