"""One row per (entity, date), and diagnostics of keys that have several."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daypanel.functions.quality import all_of
from daypanel.operators.ordering import HOT_ROWS, head
from daypanel.schema import DEFAULT_KEY, PanelKey

ROWS = "n_rows"

# ---- fixed values: columns the duplicate reports look at ----
TRADING_FIELDS = (
    "dlyprc", "prc", "dlyret", "dlyretx", "dlyreti", "dlyvol", "dlycap",
    "dlyopen", "dlyhigh", "dlylow", "dlyclose", "dlybid", "dlyask", "distype", "disseqnbr",
)
EVENT_FIELDS = ("distype", "disseqnbr", "disordinaryflg", "dispaymenttype", "disdetailtype")
EVENT_AMOUNTS = ("disdivamt", "disfacpr", "disfacshr")
COMPACT_COLUMNS = (
    "dlycaldt", "permno", "ticker", "raw_row_id", "prc", "dlyret", "dlyretx", "dlyreti", "dlyvol", "dlycap",
    "distype", "disseqnbr", "disordinaryflg", "dispaymenttype", "disdetailtype", "disdivamt", "disfacpr",
    "disfacshr", "dlyorddivamt", "dlynonorddivamt", "dlyfacprc", "dlydistretflg",
)
NULL_LABEL = "__NULL__"
# ---- end of fixed values ----


def dedup_first(df: DataFrame, key: PanelKey = DEFAULT_KEY, count_as: str | None = None) -> DataFrame:
    """Keep the first row of every (entity, date) in ``key.order``.

    ``row_number = 1`` lets Spark cut each key to one row inside every map
    task before the shuffle, so a key with any number of copies costs the
    shuffle at most one row per map task. Asking a window for the size of the
    group would undo that; ``count_as`` therefore takes the count from an
    aggregate over the key columns alone. Both sides are hashed on the same
    two columns, so joining them moves no data again.
    """
    first = Window.partitionBy(*key.pair).orderBy(*[F.asc_nulls_last(c) for c in key.order])
    kept = df.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    if count_as is None:
        return kept
    # A left join: a row whose key is NULL stays, without a count.
    return kept.join(rows_per_key(df, key).withColumnRenamed(ROWS, count_as), key.pair, "left").select(
        *df.columns, count_as
    )


def rows_per_key(df: DataFrame, key: PanelKey = DEFAULT_KEY, extra: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*extra, *key.pair).agg(F.count("*").alias(ROWS))


def duplicate_summary(df: DataFrame, by: Sequence[str] = (), key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """Rows, keys, keys with several rows, rows beyond the first, largest key."""
    n = F.col(ROWS)
    return rows_per_key(df, key, by).groupBy(*by).agg(
        F.sum(n).alias("n_total_rows"),
        F.count("*").alias("n_unique_stock_days"),
        F.sum(F.when(n > 1, 1).otherwise(0)).alias("n_duplicate_stock_days"),
        F.sum(F.when(n > 1, n - 1).otherwise(0)).alias("n_extra_duplicate_rows"),
        F.max(n).alias("max_rows_per_stock_day"),
    )


def rows_per_key_histogram(df: DataFrame, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    return rows_per_key(df, key).groupBy(ROWS).agg(F.count("*").alias("n_stock_days")).orderBy(ROWS)


def _repeated(df: DataFrame, group: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose group has several rows, with the group's size ``n_rows``: those of groups up to ``hot_rows``, dealt out by
    group once, so that what follows shuffles nothing, and those of larger groups, left where they are. There are at most
    (rows / hot_rows) of these, which bounds the broadcast. NULL is a group like any other."""
    renamed = {c: f"_g_{c}" for c in group}
    hot = df.groupBy(*group).agg(F.count("*").alias(ROWS)).filter(F.col(ROWS) > hot_rows).withColumnsRenamed(renamed)
    same = all_of(F.col(c).eqNullSafe(F.col(g)) for c, g in renamed.items())
    few = df.join(F.broadcast(hot), same, "left_anti").withColumn(ROWS, F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return few.filter(F.col(ROWS) > 1), df.join(F.broadcast(hot), same).filter(F.col(ROWS) > 1).select(*df.columns, ROWS)


def rows_of_repeated_keys(df: DataFrame, group: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose group has several rows, with the group's size ``n_rows``."""
    few, many = _repeated(df, group, hot_rows)
    return few.unionByName(many)


def _by_repeated_key(df: DataFrame, group: Sequence[str], report: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """A report with a row for each group of several rows. Groups of few rows are reported on where they were dealt to; the
    adaptive planner drops the other branch once it knows that no group is large."""
    few, many = _repeated(df, group, hot_rows)
    return report(few).unionByName(report(many))


def duplicate_event_digest(
    df: DataFrame,
    key: PanelKey = DEFAULT_KEY,
    row_id: str = "raw_row_id",
    also: Sequence[str] = ("ticker", "year"),
    fields: Sequence[str] = EVENT_FIELDS,
    amounts: Sequence[str] = EVENT_AMOUNTS,
) -> DataFrame:
    """One row per key with several rows: what its event records say.

    Sets hold each distinct value once, within a map task already, so a large
    group of copies ships only its distinct event codes.
    """
    group = [*key.pair, *also]
    label = {f: F.coalesce(F.col(f).cast("string"), F.lit(NULL_LABEL)) for f in fields}
    sets = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{f}_set") for f, c in label.items()]
    bounds = [fn(a).alias(f"{name}_{a}") for a in amounts for name, fn in (("min", F.min), ("max", F.max))]
    needed = dict.fromkeys([*group, row_id, *fields, *amounts, "distype", "disdivamt"])

    def digest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*group, ROWS).agg(
            F.min(row_id).alias(f"min_{row_id}"),
            F.max(row_id).alias(f"max_{row_id}"),
            *sets,
            F.count("distype").alias("n_distribution_rows"),
            F.count("disdivamt").alias("n_disdivamt_rows"),
            *bounds,
        )

    return _by_repeated_key(df.select(*needed), group, digest)


def duplicate_field_differences(
    df: DataFrame,
    key: PanelKey = DEFAULT_KEY,
    also: Sequence[str] = ("ticker", "year"),
    fields: Sequence[str] = TRADING_FIELDS,
) -> DataFrame:
    """Per key with several rows: how many values each field takes, NULL being
    one of them.

    The (field, value) pairs of a group of few rows are told apart in the task
    that has the group. Those of a large group meet in the map tasks and are
    spread over the shuffle by their value, so no large group is gathered.
    """
    group = [*key.pair, *also]
    # Not unpivoted: Spark would lose sight of how the rows are dealt out.
    pair = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(NULL_LABEL)).alias("value")) for f in fields]
    counts = [F.count(F.when(F.col("field") == f, 1)).alias(f"n_distinct_{f}") for f in fields]

    def distinct_values(rows: DataFrame) -> DataFrame:
        pairs = rows.select(*group, ROWS, F.inline(F.array(*pair))).distinct()
        return pairs.groupBy(*group, ROWS).agg(*counts)

    return _by_repeated_key(df.select(*group, *fields), group, distinct_values)


def duplicate_difference_rate(
    df: DataFrame, key: PanelKey = DEFAULT_KEY, fields: Sequence[str] = TRADING_FIELDS
) -> DataFrame:
    """How many keys with several rows disagree, per field; one row.

    Whether a field takes several values shows in its smallest and largest
    value and in whether it is NULL in some rows only; all three add up in the
    map tasks.
    """
    parts = [fn(f).alias(f"{name}_{f}") for f in fields for name, fn in (("min", F.min), ("max", F.max), ("n", F.count))]
    per_key = _by_repeated_key(df.select(*key.pair, *fields), key.pair, lambda rows: rows.groupBy(*key.pair, ROWS).agg(*parts))

    def differs(f: str):
        partly_null = (F.col(f"n_{f}") > 0) & (F.col(f"n_{f}") < F.col(ROWS))
        return (F.col(f"min_{f}") != F.col(f"max_{f}")) | partly_null

    sums = [F.coalesce(F.sum(F.when(differs(f), 1).otherwise(0)), F.lit(0)).alias(f"n_diff_{f}") for f in fields]
    return per_key.agg(F.count("*").alias("n_duplicate_stock_days"), *sums)


def duplicate_rows(
    df: DataFrame,
    n: int | None = 500,
    key: PanelKey = DEFAULT_KEY,
    row_id: str = "raw_row_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``n`` rows, by date, entity and row id, of keys with several rows.

    Each such key brings at least two rows, so the first ``n`` rows come from
    the first ``(n + 1) // 2`` keys: a bounded list, broadcast to the scan. None
    lists the rows of all keys, joined as the planner sees fit.
    """
    order = [F.asc_nulls_last(key.date), F.asc_nulls_last(key.entity)]
    keys = rows_per_key(df, key).filter(F.col(ROWS) > 1).select(*key.pair)
    if n is not None:
        keys = F.broadcast(keys.orderBy(*order).limit((n + 1) // 2))
    rows = df.join(keys, key.pair, "left_semi")
    if columns is not None:
        rows = rows.select(*[c for c in columns if c in df.columns])
    return head(rows.orderBy(*order, F.asc_nulls_last(row_id)), n)
