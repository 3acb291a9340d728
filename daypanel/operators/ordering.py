"""Order statistics of groups of any size: quantiles, row numbers, top rows.

Spark's exact ``percentile`` and ``row_number`` gather a group in one task.
Here a group is cut by value, so that no task sees the whole of it. Quantiles
take one path at every size; row numbers are the same however many pieces a
group is cut into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 2_000_000
SKETCH_ACCURACY = 10_000
#: of the KLL sketches behind exact quantiles: off by about one part in 800
SKETCH_SIZE = 4096
SALTS = 1024


def head(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows, or all of them for None: listings show a number of
    rows by default and are whole on request."""
    return rows if n is None else rows.limit(n)


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = SKETCH_SIZE) -> DataFrame:
    """One row a group: a KLL sketch of its numbers and what a sketch does not
    keep, for ``merged_sketches`` and ``exact_quantiles``. Store it to ask for
    quantiles of days, years and the whole table from one read. NULL is a group
    like any other; NaN counts above all numbers, as in Spark's order."""
    v = F.col("_v")
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    return rows.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        F.kll_sketch_agg_double(F.when(F.isnan(v), float("inf")).otherwise(v), F.lit(k)).alias("_sketch"),
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str], k: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups, ``by`` being some of the columns or none."""
    return sketches.groupBy(*by).agg(
        F.sum("_n").alias("_n"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.kll_merge_agg_double("_sketch", F.lit(k)).alias("_sketch"),
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    sketches: DataFrame | None = None,
    k: int = SKETCH_SIZE,
    few_groups: bool = False,
) -> DataFrame:
    """Interpolated quantiles of the non-NULL values of each group, one column
    per entry of ``quantiles``, equal to Spark's ``percentile``. NULL is a group
    like any other.

    The input is read twice, whatever the number of groups: for the sketches,
    unless ``sketches`` of the same groups are passed in, and for the values
    around each quantile, which are counted exactly. That count also shows
    whether a sketch was so far off that a value lies outside what was counted;
    only groups where one does are counted again, whole. ``few_groups`` says
    that groups are bounded in number, as days are, and their statistics may be
    broadcast; else the adaptive planner decides by their size.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    found = quantile_sketches(df, by, value, k) if sketches is None else sketches
    brackets = found.select(*by, "_n", "_low", "_high", _brackets(quantiles, k).alias("_ends"))
    first = _counted(_attached(rows, brackets, by, few_groups), by, quantiles)
    sure = F.lit(True)
    for name in quantiles:
        sure = sure & F.col(f"_sure_{name}")
    # Hardly ever any: the adaptive planner drops the branch once it knows.
    again = first.filter(~sure).select(*by, "_n", "_low", "_high")
    ends = F.array(*[F.col(c) for _ in quantiles for c in ("_low", "_high")])
    second = _counted(_attached(rows, again.withColumn("_ends", ends), by, few_groups), by, quantiles)
    return first.filter(sure).unionByName(second).select(*by, *quantiles)


def table_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], k: int = SKETCH_SIZE) -> DataFrame:
    """The same for a whole table: one row, or none where no value is present."""
    # One group, but not a literal one: joins keep a key to hash by.
    rows = df.select(F.pmod(F.xxhash64(value), F.lit(1)).alias("_all"), value)
    return exact_quantiles(rows, ["_all"], value, quantiles, k=k, few_groups=True).drop("_all")


def column_quantiles(
    df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]], few_groups: bool = False
) -> DataFrame:
    """Exact quantiles of several columns in the same two reads: ``wanted`` maps
    an output name to ``(column, quantile)``. Groups without any value in all of
    the columns are left out."""
    by = list(by)
    columns = dict.fromkeys(c for c, _ in wanted.values())
    records = [F.struct(F.lit(c).alias("_variable"), F.col(c).cast("double").alias("_value")) for c in columns]
    steps = {p: f"_q{i}" for i, p in enumerate(dict.fromkeys(p for _, p in wanted.values()))}
    rows = df.select(*by, F.inline(F.array(*records)))
    found = exact_quantiles(rows, [*by, "_variable"], "_value", {q: p for p, q in steps.items()}, few_groups=few_groups)
    picks = [F.max(F.when(F.col("_variable") == c, F.col(steps[p]))).alias(out) for out, (c, p) in wanted.items()]
    return found.groupBy(*by).agg(*picks)


def _attached(rows: DataFrame, stats: DataFrame, by: list[str], few: bool) -> DataFrame:
    """The values with the statistics of their group."""
    renamed = {c: f"_g_{c}" for c in by}
    same = [F.col(c).eqNullSafe(F.col(g)) for c, g in renamed.items()]
    stats = stats.withColumnsRenamed(renamed)
    return rows.join(F.broadcast(stats) if few else stats, same).drop(*renamed.values())


def _brackets(quantiles: dict[str, float], k: int) -> Column:
    """Two values around each quantile. A sketch of size ``k`` is off by about
    2.3 / k ** 0.9 of the rows; the margin is wider. Groups of so few rows that
    the margin is less than three of them are taken whole."""
    margin = 4.0 / k**0.9
    infinity = F.lit(float("inf"))
    ends = []
    for p in quantiles.values():
        low, high = F.col("_low"), F.col("_high")
        if p > margin:
            low = F.kll_sketch_get_quantile_double("_sketch", F.lit(p - margin))
        if p + margin < 1:
            # NaN is an infinity to the sketch.
            found = F.kll_sketch_get_quantile_double("_sketch", F.lit(p + margin))
            high = F.when(found < infinity, found).otherwise(high)
        for sketched, end in ((low, "_low"), (high, "_high")):
            ends.append(F.when(F.col("_n") * margin < 3, F.col(end)).otherwise(sketched))
    return F.array(*ends)


def _positions(quantiles: dict[str, float]) -> list[tuple[str, Column]]:
    return [(name, (F.col("_n") - 1) * F.lit(p)) for name, p in quantiles.items()]


def _counted(rows: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of groups of ``_n`` rows within the brackets ``_ends``, and
    ``_sure_<name>``: whether both ranks of a quantile lie within its bracket.

    Values inside a bracket are kept and values below one are counted onto its
    lower end, those above all onto the largest value, apart from those that are
    equal to it: a rank that falls among them was not found. Equal values add up in the map
    tasks, and the cumulative counts run over the few values inside the brackets.
    """
    v, ends_of = F.col("_v"), F.col("_ends")
    brackets = [(ends_of[2 * i], ends_of[2 * i + 1]) for i in range(len(quantiles))]
    inside = F.lit(False)
    for low, high in brackets:
        inside = inside | v.between(low, high)
    next_low = F.array_min(F.array(*[F.when(low > v, low) for low, _ in brackets], F.col("_high")))
    group = [*by, "_n", "_low", "_high"]
    counts = (
        rows.select(*group, F.when(inside, v).otherwise(next_low).alias("_slot"), inside.alias("_inside"))
        .groupBy(*group, "_slot", "_inside")
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*by).orderBy("_slot", "_inside").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("_cum", F.sum("_c").over(upto))

    picks, columns, checks = [], [], []
    for name, position in _positions(quantiles):
        for end, rank in (("lo", F.floor(position) + 1), ("hi", F.ceil(position) + 1)):
            slot = F.when(F.col("_cum") >= rank, F.struct("_slot", "_inside"))
            picks.append(F.min(slot).alias(f"_{name}_{end}"))
        low, high = F.col(f"_{name}_lo._slot"), F.col(f"_{name}_hi._slot")
        # Equal ends need no weights, which an infinite value could not bear.
        between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
        columns.append(F.when(low == high, low).otherwise(between).alias(name))
        known = F.col(f"_{name}_lo._inside") & F.col(f"_{name}_hi._inside")
        checks.append(F.coalesce(known, F.lit(False)).alias(f"_sure_{name}"))
    return cumulated.groupBy(*group).agg(*picks).select(*group, *columns, *checks)


def _image(df: DataFrame, column: str) -> Column:
    """A number that grows with the column in Spark's order, for cut points:
    for text, its first seven bytes."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def add_row_number(
    df: DataFrame,
    by: str,
    value: str,
    tie: str,
    out: str,
    hot_rows: int = HOT_ROWS,
    cuts: int = 64,
    accuracy: int = SKETCH_ACCURACY,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group by ``value`` descending, NULL last, then
    ``tie`` ascending; both may be of any type that has an order.

    A group above ``hot_rows`` is cut at about ``cuts`` values into pieces that follow each
    other in that order. A row's number is its number within its piece plus the
    sizes of the pieces before. A value that is a cut itself gets a piece of
    its own, which is cut again along ``tie``, and so do NULL values: one value
    held by very many rows is split too. ``sizes`` may pass in the groups with
    their row count ``_n`` where the caller has them already.
    """
    steps = [(i + 1) / (cuts + 1) for i in range(cuts)]
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")) if sizes is None else sizes
    hot = sizes.filter(F.col("_n") > hot_rows).select(by)
    image = {"_v": _image(df, value), "_t": _image(df, tie)}
    cut_points = (
        df.join(hot, by, "left_semi")
        .select(by, *(c.alias(name) for name, c in image.items()))
        .groupBy(by)
        .agg(
            F.percentile_approx("_v", steps, accuracy).alias("_cuts"),
            F.percentile_approx("_t", steps, accuracy).alias("_ties"),
        )
    )
    v, t = F.col("_v"), F.col("_t")
    is_hot = F.col("_cuts").isNotNull()
    # Looked up once per row; NULL where the group is not cut.
    located = df.withColumns(image).join(cut_points, by, "left").withColumns(
        {
            "_below": F.size(F.filter("_cuts", lambda x: x < v)),
            "_upto": F.size(F.filter("_cuts", lambda x: x <= v)),
            "_tie": F.when(t.isNull(), cuts + 1).otherwise(F.size(F.filter("_ties", lambda x: x <= t))),
        }
    )
    piece = F.when(~is_hot, 0).when(v.isNull(), 1).otherwise(-(F.col("_below") + F.col("_upto")))
    shared = v.isNull() | (F.col("_below") != F.col("_upto"))
    part = F.when(is_hot & shared, F.col("_tie")).otherwise(0)
    cut = located.select(*df.columns, piece.alias("_piece"), part.alias("_part"), is_hot.alias("_hot"))
    pieces = [by, "_piece", "_part"]
    before = Window.partitionBy(by).orderBy("_piece", "_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most (2 cuts + 1) + (cuts + 1) (cuts + 1) pieces per hot group.
    offsets = (
        cut.filter("_hot")
        .groupBy(*pieces)
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    within = Window.partitionBy(*pieces).orderBy(F.desc_nulls_last(value), F.asc_nulls_last(tie))
    numbered = cut.withColumn("_within", F.row_number().over(within)).join(offsets, pieces, "left")
    number = (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long")
    return numbered.select(*df.columns, number.alias(out))


def keep_top(
    df: DataFrame,
    by: str,
    ranks: dict[str, tuple[Column, int]],
    tie: str,
    count_as: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Rows that stand within the first ``k`` of their group in *every* given
    order, with their exact numbers; ``ranks`` maps an output name to
    ``(descending value, k)``.

    Groups are first split into ``salts`` parts and each part keeps only rows
    within the first ``k`` of *some* order, since others cannot reach the first
    ``k`` of the group. Every row ahead of a true top row is itself kept, so
    numbers up to ``k`` computed on what is left are exact, and rows beyond
    ``k`` still have ``k`` kept rows ahead of them. The second step sees at
    most ``salts * sum(k)`` rows per group, however large the group is.
    """
    names = list(ranks)
    part = F.pmod(F.xxhash64(tie), F.lit(salts))

    def number(groups, name):
        value, _ = ranks[name]
        return F.row_number().over(Window.partitionBy(*groups).orderBy(value.desc_nulls_last(), F.asc_nulls_last(tie)))

    salted = df.withColumn("_part", part)
    parts = [by, "_part"]
    local = salted.withColumns(
        {f"_{n}": number(parts, n) for n in names}
        | {"_part_rows": F.count("*").over(Window.partitionBy(*parts))}
    )
    some = F.lit(False)
    for n in names:
        some = some | (F.col(f"_{n}") <= ranks[n][1])
    kept = local.filter(some)

    added = {n: number([by], n).cast("long") for n in names}
    if count_as is not None:
        # Each part keeps exactly one row numbered 1, which speaks for its part.
        once = F.when(F.col(f"_{names[0]}") == 1, F.col("_part_rows"))
        added[count_as] = F.sum(once).over(Window.partitionBy(by))
    result = kept.withColumns(added)
    for n in names:
        result = result.filter(F.col(n) <= ranks[n][1])
    return result.select(*df.columns, *added)
