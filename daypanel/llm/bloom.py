"""Blocked Bloom filters of a bounded size, by built-in functions. The filter is a table of bitmaps; a key hits two bits of
one block of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import free_name, saved

BITS_PER_ROW = 16
#: bits of one bitmap of bitmap_construct_agg
BLOCK_BITS = 32768


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key's hash and its two bits there."""
    h = F.xxhash64(key)
    return h.bitwiseAND(F.lit(blocks - 1)), [F.shiftright(h, n).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in (24, 40)]


def hit_bits(keys: DataFrame, key: str, blocks: int, least: int = 1) -> DataFrame:
    """``(_block, _bits)``: for each block of the filter a bitmap of the bits that ``least`` rows or more hit. Hits are
    counted before they are shuffled, so a key with many rows costs two counts a task."""
    block, bits = _places(F.col(f"`{key}`"), blocks)
    hit = keys.select(block.alias("_block"), F.explode(F.array_distinct(F.array(*bits))).alias("_bit"))
    often = hit.groupBy("_block", "_bit").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return often.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def blocks_for(rows: int, max_filter_mb: int) -> int:
    """A power of two: the blocks of a filter for so many rows."""
    most = max_filter_mb * 2**20 * 8 // BLOCK_BITS
    return 2 ** min(math.ceil(math.log2(max(1, rows * BITS_PER_ROW / BLOCK_BITS))), int(math.log2(most)))


def mark_possible_repeats(df: DataFrame, key: str, out: str, max_filter_mb: int = 64) -> DataFrame:
    """``df`` with a boolean ``out``: whether another row may have the same ``key``. Never false where one has. The
    filter, at most ``max_filter_mb``, is broadcast; ``df`` is not shuffled."""
    blocks = blocks_for(df.count(), max_filter_mb)
    return _marked(df, key, out, saved(hit_bits(df.select(f"`{key}`"), key, blocks, 2)), blocks)


def mark_possible_members(df: DataFrame, keys: DataFrame, key: str, out: str, max_filter_mb: int = 64) -> DataFrame:
    """``df`` with a boolean ``out``: whether its ``key`` may be among those of ``keys``. Never false where it is."""
    blocks = blocks_for(keys.count(), max_filter_mb)
    return _marked(df, key, out, saved(hit_bits(keys.select(f"`{key}`"), key, blocks)), blocks)


def _marked(df: DataFrame, key: str, out: str, filled: DataFrame, blocks: int) -> DataFrame:
    at, own_block, own_bits = (free_name(df.columns, c) for c in ("_at", "_block", "_bits"))
    filled = filled.toDF(own_block, own_bits)
    block, bits = _places(F.col(f"`{key}`"), blocks)

    def hit(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(own_bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))

    joined = df.withColumn(at, block).join(F.broadcast(filled), F.col(at) == F.col(own_block), "left")
    return joined.withColumn(out, hit(bits[0]) & hit(bits[1])).drop(at, own_block, own_bits)
