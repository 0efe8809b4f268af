"""Blocked Bloom filters as an array column of fixed size, built and probed with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a filter where the number of its keys is not known: 64 bits each, so 512 KB for 65,536 of them.
BLOCKS = 1 << 16
#: The least and the most blocks of a filter sized by its keys: 8 KB and 8 MB.  At 16 bits a key that is room for four million
#: keys; more only pass more false positives on to the exact join behind the filter.
FEWEST, MOST = 1 << 10, 1 << 20
#: Bits that a key sets in its block.
BITS = 4


def blocks_for(keys: int) -> int:
    """A power of two of blocks that gives each of ``keys`` keys 16 bits, within the bounds."""
    return min(MOST, max(FEWEST, 1 << max(0, (keys - 1) // 4).bit_length()))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, bits: int) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(bits):
        place = F.pmod(F.hash(F.lit(i), key), F.lit(64))
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS, bits: int = BITS) -> DataFrame:
    """One row, one column: the blocks of the filter as ``array<bigint>``.

    Keys are ORed into their blocks where they are; exactly ``blocks`` small rows meet in the last task.
    """
    set_bits = keys.select(_block(F.col(key), blocks).alias("b"), _mask(F.col(key), bits).alias("m"))
    empty = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("m"))
    merged = set_bits.unionByName(empty).groupBy("b").agg(F.bit_or("m").alias("m"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"]).alias("filter"))


def may_hold(filter_column: Column, key: Column, blocks: int = BLOCKS, bits: int = BITS) -> Column:
    """False only for keys the filter does not hold; null keys are not held."""
    mask = _mask(key, bits)
    return F.coalesce(key.isNotNull() & (F.get(filter_column, _block(key, blocks)).bitwiseAND(mask) == mask), F.lit(False))
