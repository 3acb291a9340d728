"""Where a property of rows is concentrated, and how values are distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.functions.quality import all_of
from daypanel.functions.rules import CORE_RULES, column_rule
from daypanel.operators.ordering import head, table_quantiles
from daypanel.schema import require_columns

# ---- fixed values: default groups, the population of regular rows, sentinels ----
GROUP_COLUMNS = ("year", "primaryexch", "securitytype", "sharetype", "tradingstatusflg")
REGULAR_ROWS = {"tradingstatusflg": "A", "securityactiveflg": "Y", "dlydelflg": "N"}
MISSING_LABEL = "__MISSING__"
TOP_GROUPS = 100
# ---- end of fixed values ----


def regular_rows(df: DataFrame) -> DataFrame:
    """Active securities on active, non-delisting days."""
    return df.filter(all_of(F.col(c) == v for c, v in REGULAR_ROWS.items()))


def pattern_by_group(
    df: DataFrame, condition: Column, name: str, groups: Sequence[str] = GROUP_COLUMNS, top: int | None = TOP_GROUPS
) -> DataFrame:
    """Groups by how many of their rows meet a condition, largest first; the
    first ``top`` of them, or all for None."""
    require_columns(df, groups)
    n, rate = f"n_{name}", f"{name}_rate"
    met = F.coalesce(condition, F.lit(False))
    ordered = (
        df.groupBy(*groups)
        .agg(F.count("*").alias("n_rows"), F.count_if(met).alias(n))
        .filter(F.col(n) > 0)
        .withColumn(rate, F.col(n) / F.col("n_rows"))
        .orderBy(F.desc(n), *[F.asc_nulls_last(g) for g in groups])
    )
    return head(ordered, top)


def missing_by_group(df: DataFrame, variable: str, groups=GROUP_COLUMNS, top: int | None = TOP_GROUPS) -> DataFrame:
    require_columns(df, [variable])
    return pattern_by_group(df, F.col(variable).isNull(), "missing", groups, top)


def nonmissing_by_group(df: DataFrame, variable: str, groups=GROUP_COLUMNS, top: int | None = TOP_GROUPS) -> DataFrame:
    """Over the regular rows."""
    require_columns(df, [variable])
    return pattern_by_group(regular_rows(df), F.col(variable).isNotNull(), "nonmissing", groups, top)


def abnormal_by_group(
    df: DataFrame,
    variable: str,
    predicate: str | None = None,
    groups=GROUP_COLUMNS,
    top: int | None = TOP_GROUPS,
    registry=CORE_RULES,
) -> DataFrame:
    """By the registered rule of the variable or by the caller's own, which is
    analysed before anything runs."""
    require_columns(df, [variable])
    rule = column_rule(variable, predicate, registry, df)
    require_columns(df, rule.columns)
    return pattern_by_group(df, rule.hit(), "abnormal", groups, top)


def value_counts(
    df: DataFrame,
    variable: str,
    where: Column | None = None,
    null_label: str | None = None,
    as_name: str = "value",
    count_name: str = "n_rows",
    top: int | None = None,
) -> DataFrame:
    """Rows per value, most frequent first; NULL under a label if one is given."""
    require_columns(df, [variable])
    rows = df if where is None else df.filter(where)
    value = F.col(variable).cast("string")
    if null_label is not None:
        value = F.coalesce(value, F.lit(null_label))
    counts = rows.groupBy(value.alias(as_name)).agg(F.count("*").alias(count_name))
    ordered = counts.orderBy(F.desc(count_name), F.asc_nulls_last(as_name))
    return head(ordered, top)


def nonmissing_values(df: DataFrame, variable: str, top: int = 50) -> DataFrame:
    return value_counts(regular_rows(df), variable, F.col(variable).isNotNull(), top=top)


def numeric_summary(df: DataFrame, variable: str, exact: bool = True) -> DataFrame:
    """Size, missing values, range and five quantiles of a variable; one row."""
    require_columns(df, [variable])
    quantiles = {"p01": 0.01, "p05": 0.05, "p50": 0.50, "p95": 0.95, "p99": 0.99}
    v = F.col(variable)
    frame = [
        F.count("*").alias("n_total"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    ]
    if not exact:
        sketch = F.percentile_approx(v, list(quantiles.values())).alias("_q")
        columns = [F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)]
        found = df.agg(*frame, sketch).select("n_total", "n_missing", "min_value", *columns, "max_value")
        return found
    found = table_quantiles(df, variable, quantiles).select(F.struct(*quantiles).alias("q"))
    return df.agg(*frame).withColumn("q", found.scalar()).select(
        "n_total", "n_missing", "min_value", *[F.col(f"q.{n}").alias(n) for n in quantiles], "max_value"
    )


def histogram(df: DataFrame, variable: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram without empty bins; the largest value falls into
    the last bin. No rows where all values are missing or equal."""
    require_columns(df, [variable])
    v = F.col(variable).cast("double")
    rows = df.select(v.alias("v")).filter("v IS NOT NULL")
    extremes = rows.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("extremes"))
    bounded = rows.withColumn("x", extremes.scalar()).filter("x.high > x.low")
    low, width = F.col("x.low"), F.col("x.high") - F.col("x.low")
    bin_id = F.least(F.floor((F.col("v") - low) / width * bins), F.lit(bins - 1)).cast("int")
    counts = bounded.groupBy(bin_id.alias("bin_id"), low.alias("low"), width.alias("width")).agg(
        F.count("*").alias("count")
    )
    left = F.col("low") + F.col("bin_id") * F.col("width") / bins
    right = F.col("low") + (F.col("bin_id") + 1) * F.col("width") / bins
    return counts.select(
        "bin_id", "count", left.alias("bin_left"), right.alias("bin_right"), ((left + right) / 2).alias("bin_mid")
    ).orderBy("bin_id")
