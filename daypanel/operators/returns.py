"""Trailing return features over the valid rows of a security."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.schema import DEFAULT_KEY, PanelKey


def add_trailing_returns(
    df: DataFrame,
    rows: tuple[int, ...] = (5, 21),
    volatility_rows: int = 21,
    value: str = "dlyret",
    key: PanelKey = DEFAULT_KEY,
) -> DataFrame:
    """Compounded return and standard deviation over the last rows, on rows
    with a return; NULL until there are enough of them. (entity, date) must be
    unique.
    """
    key.check_date(df)
    series = Window.partitionBy(key.entity).orderBy(key.date)
    growth = 1 + F.col(value)

    def compounded(n: int):
        # Oldest first, as an explicit product: a log would fail at -100%. One
        # frame and one fold, so the plan does not grow with n.
        frame = F.collect_list(growth).over(series.rowsBetween(-(n - 1), 0))
        product = F.aggregate(frame, F.lit(1.0), lambda whole, one: whole * one)
        return F.when(F.size(frame) == n, product - 1)

    recent = series.rowsBetween(-(volatility_rows - 1), 0)
    enough = F.count(value).over(recent) == volatility_rows
    return df.filter(F.col(value).isNotNull()).withColumns(
        {f"ret_{n}d": compounded(n) for n in rows}
        | {f"vol_{volatility_rows}d": F.when(enough, F.stddev_samp(value).over(recent))}
    )
