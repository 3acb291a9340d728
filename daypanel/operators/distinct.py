"""Distinct ids that add up: exact bitmaps per group, merged to coarser groups.

``count_distinct`` deals every (group, id) pair out again for every grouping.
A bitmap holds the ids of a group within a range of 32,768 of them; the bitmaps
of days, made where the rows are read, merge to those of years and of the
table, and bits are counted. Counts are those of ``count_distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, IDS = "_bucket", "_ids"


def has_bitmaps(df: DataFrame, entity: str) -> bool:
    """Whole numbers have a place in a bitmap; other ids do not."""
    return isinstance(df.schema[entity].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def id_bitmaps(df: DataFrame, by: Sequence[str], entity: str, **more: Column) -> DataFrame:
    """One row a group and range of ids, with the ids it holds and further
    aggregates of its rows. NULL is no id, but its rows count in the others."""
    number = F.col(entity).cast("long")
    return df.groupBy(*by, F.bitmap_bucket_number(number).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(IDS), *[c.alias(n) for n, c in more.items()]
    )


def distinct_ids(bitmaps: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Distinct ids of the groups ``by``, the same as those of the bitmaps or
    coarser; none at all for one row over the whole table."""
    merged = bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(IDS).alias(IDS))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(IDS)), F.lit(0)).alias(out))


def distinct_pairs(bitmaps: DataFrame, by: Sequence[str]) -> Column:
    """Distinct pairs of a group and an id, over all rows of the bitmaps of
    ``by``: nothing is merged, groups without a NULL key just add up."""
    present = F.lit(True)
    for c in by:
        present = present & F.col(c).isNotNull()
    counted = bitmaps.agg(F.coalesce(F.sum(F.when(present, F.bitmap_count(IDS))), F.lit(0)).alias("n"))
    return counted.scalar()
