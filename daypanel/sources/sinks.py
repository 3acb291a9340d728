"""Writing stage tables and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from daypanel import session
from daypanel.schema import DEFAULT_KEY, PanelKey

PART_ROWS = 300_000
SERIES_BUCKETS = 200
#: rows of a bucket that a task sorts, about, in tables of a few hundred bytes a row
BUCKET_ROWS = 250_000
#: rows that are dealt out at a time, about, and the most rounds, since each of them reads what the rows come from
ROUND_ROWS, MOST_ROUNDS = 4_000_000, 8
#: the directory of rows without a year
NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def write_parts(df: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


class RepeatedKeys(ValueError):
    """A stage that should have one row per (entity, date) has more."""


def write_panel(
    df: DataFrame,
    path: str,
    by: str = "year",
    rows_per_file: int = 0,
    keep_others: bool = False,
    metrics: Mapping[str, Column] | None = None,
) -> dict:
    """Replace a stage table, one directory per year, and return what was seen
    on the way: ``rows`` and the given aggregates, counted as rows are written.

    REBALANCE gathers a year's rows for few files, yet lets the adaptive
    planner split a year that is large and merge years that are small; a plain
    repartition would write a large year from one task.

    Years are staged and moved into place when all of them are written, so a
    write that fails leaves the table as it was. With ``keep_others`` only the
    years of ``df`` are replaced and no file of another one is touched; else
    years that ``df`` does not have are removed at the end.
    """
    seen = Observation()
    rows = df.hint("rebalance", F.col(by)).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.collect_set(F.coalesce(F.col(by).cast("string"), F.lit(""))).alias("_years"),
        *[c.alias(n) for n, c in (metrics or {}).items()],
    )
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )
    found = dict(seen.get)
    years = found.pop("_years")
    if not keep_others:
        _remove_others(df.sparkSession, path, by, years)
    return found


def _remove_others(spark: SparkSession, path: str, by: str, years: list[str]) -> None:
    """Directories of years that are not among ``years``, with names as Spark spells them."""
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    kept = {f"{named(by)}={named(y) if y else NO_PARTITION}" for y in years}
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith(f"{named(by)}=") and name not in kept:
            files.delete(entry.getPath(), True)


def write_series(
    df: DataFrame,
    path: str,
    key: PanelKey = DEFAULT_KEY,
    buckets: int = SERIES_BUCKETS,
    metrics: Mapping[str, Column] | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = 1,
) -> tuple[DataFrame, dict]:
    """Deal a stage table out once: every security's rows lie in one of
    ``buckets`` files, by day. Whatever reads the table by security, or by
    security and day, finds them there and shuffles nothing: windows, first
    rows, joins with other tables dealt into as many buckets (with the settings
    of ``session.tune``).

    Returns the table and what was seen while it was written. A security has at
    most one row a day, which bounds a bucket; the write compares each row with
    the one before it and raises ``RepeatedKeys`` where two share their day.

    ``then`` makes the rows of the table from those of ``df`` after these were
    dealt out, so that only what it needs is shuffled. It must keep the key's
    columns and look at one security at a time.

    Shuffle files go when what they were for is written. In several ``rounds``,
    each of as many buckets, only those of one round are on disk beside the
    table, whatever its size; ``df`` is computed for the securities of a round
    alone, its filter reaches the scan, but every round reads its input anew.
    """
    key.check_date(df)
    if buckets % rounds:
        raise ValueError(f"{buckets} buckets are not {rounds} rounds of as many")
    if metrics and rounds > 1:
        raise ValueError("metrics are taken over one round")
    name, found = f"series_{uuid.uuid4().hex}", {}
    for k in range(rounds):
        seen = Observation()
        watched = dealt(df, key, buckets, then, rounds, k).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_before") == F.col(key.date)).alias("repeated"),
            *[c.alias(n) for n, c in (metrics or {}).items()],
        ).drop("_before")
        with session.settings(df.sparkSession, session.SHUFFLES_GO):
            (
                watched.write.mode("append" if k else "overwrite")
                .bucketBy(buckets, key.entity)
                .sortBy(key.entity, key.date)
                .option("compression", "zstd")
                .option("path", path)
                .saveAsTable(name)
            )
        found = {n: found[n] + v if k else v for n, v in seen.get.items()}
    if found["repeated"]:
        raise RepeatedKeys(f"{path}: {found['repeated']} of {found['rows']} rows share {key.entity} and {key.date} with another")
    return df.sparkSession.table(name), found


def dealt(
    df: DataFrame, key: PanelKey, buckets: int, then: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 1, k: int = 0
) -> DataFrame:
    """The rows of round ``k`` of ``write_series``, a partition for each of its buckets, with ``_before``, the day of the row
    before. A round has buckets that follow each other: modulo their number they are the partitions that Spark deals to."""
    size, series = buckets // rounds, Window.partitionBy(key.entity).orderBy(key.date)
    if rounds > 1:
        # The bucket as Spark's writer finds it.
        df = df.filter(F.pmod(F.hash(key.entity), F.lit(buckets)).between(k * size, (k + 1) * size - 1))
    rows = df.repartition(size, F.col(key.entity))
    return (then(rows) if then else rows).withColumn("_before", F.lag(key.date).over(series))


def series_buckets(rows: int, least: int = 8, rows_per_bucket: int = BUCKET_ROWS) -> int:
    """How many buckets keep what one task reads and sorts bounded, whatever the number of rows. A security has at most one
    row a day, so more rows are more securities and spread. Tables to be joined take the same number, of the larger one."""
    return max(least, -(-rows // rows_per_bucket))


def series_rounds(rows: int, rows_per_round: int = ROUND_ROWS, most: int = MOST_ROUNDS) -> int:
    """In how many rounds a table is dealt out, so that shuffle files are an eighth of what they would be, or those of a few
    million rows where that is more."""
    return min(most, max(1, -(-rows // rows_per_round)))


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, quotes doubled within quotes and text as it is; NULL
    is an empty field and empty text a quoted one. ``single_file`` is for
    reports of a few rows."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", '""')
        .option("nullValue", "")
        .csv(path)
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate data, in the shared folder the cluster names
    in ``spark.checkpoint.dir``; in a session without one, as in tests, in the
    warehouse, which all executors share too."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    return f"{root.rstrip('/')}/daypanel/{name}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Marks a written path to be removed when the session ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written once and read back: for a result that is read
    several times, and with a lineage that ends at files other executors see."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
