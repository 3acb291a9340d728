"""Exact duplicates by two passes over a blocked Bloom filter.

Two texts are equal when they are identical after lower-casing A-Z; null counts as the empty text.

The first pass hashes every text to two bits of one block of the filter and keeps the bits that two rows or more hit.
The second pass looks every row up: where one of its bits was hit once, no other row has its text, and it passes
straight through. Only the other rows are shuffled, and an exact comparison of SHA-256 digests decides on them.

The filter has ``bloom.BITS_PER_ROW`` bits a row up to ``max_filter_mb``, so what is broadcast has a fixed bound. Beyond it
the filter gets fuller and more rows take the exact way; results are the same at any size.

Defined cases: an empty table gives an empty result; of rows with equal text the largest id stays, a null id being the
smallest; of rows that share text and id exactly one stays; other columns are carried along whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.bloom import mark_possible_repeats
from daypanel.llm.common import free_name, saved, whole


def folded(text: Column | str) -> Column:
    """The text with A-Z lower-cased and nothing else changed. ``lower`` does that to plain ASCII and is the faster."""
    t = whole(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))


def digest(text: Column | str) -> Column:
    return F.sha2(F.encode(folded(text), "UTF-8"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = 64) -> DataFrame:
    """One row for each row of ``docs``: the id, ``keep_id`` (id of the row of equal text that stays), ``group_size``,
    ``kept`` and ``text_sha256`` of the folded text. Only the id and the digest are carried through the work."""
    narrow = saved(
        docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("text_sha256")).withColumn("_row", F.monotonically_increasing_id())
    )
    marked = mark_possible_repeats(narrow, "text_sha256", "_maybe", max_filter_mb)
    alone = marked.filter(~F.col("_maybe")).select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    several = marked.filter("_maybe")
    # Saved, so that the join below deals both sides out itself and may split a group that holds much of the rows.
    groups = saved(
        several.groupBy(F.col("text_sha256").alias("_sha"))
        .agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count("*").alias("_n"))
        .filter("_n >= 2")
    )
    matched = several.join(groups, F.col("text_sha256") == F.col("_sha"), "left").select(
        "_id",
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_top._id")).alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_top._row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(matched).withColumnRenamed("_id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns. Rows that cannot be copies are not shuffled;
    of the others, each task sends one row a text."""
    sha, maybe = free_name(docs.columns, "_sha"), free_name(docs.columns, "_maybe")
    marked = mark_possible_repeats(docs.withColumn(sha, digest(text_col)), sha, maybe, max_filter_mb)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = F.max_by(own, F.struct(F.col(f"`{id_col}`"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))))
    kept = marked.filter(F.col(maybe)).groupBy(sha).agg(first.alias("_kept")).select("_kept.*")
    return marked.filter(~F.col(maybe)).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(kept)
