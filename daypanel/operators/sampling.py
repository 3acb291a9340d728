"""A random sample of a given size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daypanel.operators.examples import SEED, draw_order
from daypanel.schema import DEFAULT_KEY, PanelKey

ESTIMATE_ROWS = 10_000
#: hexadecimal digits of a hash that are counted at a time, and how often
DIGIT, LEVELS = 4, 2
MEGABYTE = 1024 * 1024
ABOVE_ALL_DRAWS = "g"  # hashes are hexadecimal


def csv_bytes(df: DataFrame) -> Column:
    """Bytes of a row as a CSV line: its values, separators and line end.
    Doubles are measured with ten decimals, or as Spark writes them where they
    have no such form."""

    def text(f: T.StructField) -> Column:
        c = F.col(f.name)
        plain = c.cast("string")
        if isinstance(f.dataType, T.DoubleType):
            return F.coalesce(c.try_cast("decimal(38,10)").cast("string"), plain)
        return plain

    lengths = [F.coalesce(F.octet_length(text(f)), F.lit(0)) for f in df.schema.fields]
    return sum(lengths, F.lit(len(lengths)))


def _bin_holding(bins: DataFrame, wanted: Column) -> Column:
    """Of ``(bin, n)``, a bounded number of them, the bin that holds the
    ``wanted``-th row and how many rows of it are wanted, as a scalar."""
    listed = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins")).select("bins", wanted.alias("left"))
    start = F.struct(F.lit(None).cast("string").alias("bin"), F.col("left").alias("left"))

    def step(found: Column, one: Column) -> Column:
        # Rows are counted off bin by bin until one holds those that are left.
        holds = found["bin"].isNull() & (found["left"] <= one["n"]) & (found["left"] > 0)
        passed = F.when(found["bin"].isNull() & ~holds, found["left"] - one["n"]).otherwise(found["left"])
        return F.struct(F.when(holds, one["bin"]).otherwise(found["bin"]).alias("bin"), passed.alias("left"))

    return listed.select(F.aggregate("bins", start, step).alias("found")).scalar()


def kth_draw(draws: DataFrame, wanted: Column) -> Column:
    """The ``wanted``-th smallest of the ``_draw`` hashes, equal ones counted one
    by one, as a scalar; NULL where there are fewer, or none is wanted.

    Found digit by digit: counts of the first 16 bits tell in which of 65,536
    bins it lies. The hashes of that bin are counted one by one, dealt out as
    they are, and the next 16 bits of them lead to a bin of one row in four
    thousand million, and so on for ``LEVELS`` digits; what is left is listed.
    Two reads; nothing is sorted or gathered but counts.
    """
    first = draws.groupBy(F.substring("_draw", 1, DIGIT).alias("bin")).agg(F.count("*").alias("n"))
    found = _bin_holding(first, wanted)
    inside = draws.filter(F.startswith(F.col("_draw"), found["bin"])).groupBy("_draw").agg(F.count("*").alias("n"))
    for level in range(1, LEVELS):
        part = inside.filter(F.startswith(F.col("_draw"), found["bin"]))
        bins = part.groupBy(F.substring("_draw", 1, DIGIT * (level + 1)).alias("bin")).agg(F.sum("n").alias("n"))
        found = _bin_holding(bins, found["left"])
    last = inside.filter(F.startswith(F.col("_draw"), found["bin"])).select(F.col("_draw").alias("bin"), "n")
    return _bin_holding(last, found["left"])["bin"]


def average_row_bytes(df: DataFrame, n: int = ESTIMATE_ROWS, seed: int = SEED, key: PanelKey = DEFAULT_KEY):
    """One row: the mean CSV size over ``n`` random rows, and over all rows with
    the last of their hashes; over the whole table where it has no more."""
    drawn = df.select(draw_order(key, seed).alias("_draw"), csv_bytes(df).alias("_bytes"))
    cut = F.coalesce(kth_draw(drawn.select("_draw"), F.lit(n).cast("bigint")), F.lit(ABOVE_ALL_DRAWS))
    return drawn.filter(F.col("_draw") <= cut).agg(F.avg("_bytes").alias("avg_bytes_per_row"))


def size_estimate(
    df: DataFrame, megabytes: float, seed: int = SEED, estimate_rows: int = ESTIMATE_ROWS, key: PanelKey = DEFAULT_KEY
) -> DataFrame:
    """One row: the mean row size that fixes a sample and the number of rows that
    are wanted; the sample has fewer where the table does."""
    return average_row_bytes(df, estimate_rows, seed, key).select(
        F.lit(float(megabytes)).alias("target_size_mb"),
        "avg_bytes_per_row",
        F.floor(F.lit(megabytes * MEGABYTE) / F.col("avg_bytes_per_row")).cast("bigint").alias("n_wanted"),
    )


def sample_to_size(
    df: DataFrame,
    megabytes: float,
    seed: int = SEED,
    estimate_rows: int = ESTIMATE_ROWS,
    key: PanelKey = DEFAULT_KEY,
) -> DataFrame:
    """As many random rows as make about ``megabytes`` of CSV.

    Rows are taken in the order of a hash of their key. The last hash to take
    is found by counting, so the sample itself is a filter, whatever its size.
    """
    wanted = size_estimate(df, megabytes, seed, estimate_rows, key).select("n_wanted")
    last = kth_draw(df.select(draw_order(key, seed).alias("_draw")), wanted.scalar())
    # Without such a row the sample is the whole table, or nothing.
    everything = F.when(wanted.scalar() > 0, ABOVE_ALL_DRAWS)
    cut = F.coalesce(last, everything)
    return df.withColumn("_draw", draw_order(key, seed)).filter(F.col("_draw") <= cut).drop("_draw")


def sample_summary(sample: DataFrame, megabytes: float, key: PanelKey = DEFAULT_KEY) -> DataFrame:
    """Size, span and distinct days and securities of a sample; one row."""
    size = F.sum("_bytes")
    return sample.withColumn("_bytes", csv_bytes(sample)).agg(
        F.lit(float(megabytes)).alias("target_size_mb"),
        (size / MEGABYTE).alias("actual_size_mb"),
        F.count("*").alias("n_rows"),
        F.avg("_bytes").alias("avg_bytes_per_row"),
        F.min(key.date).alias("min_date"),
        F.max(key.date).alias("max_date"),
        F.count_distinct(key.date).alias("n_unique_dates"),
        F.count_distinct(key.entity).alias("n_unique_permnos"),
    )
