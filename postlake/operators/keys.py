"""Key lookup in a large store (J1, F2): Bloom semi-join reduction.

The keys of a batch become a blocked Bloom filter: a key sets one bit in each of
the eight 64-bit words of its block.  The filter is a table of at most ``blocks``
rows, so broadcasting it is bounded whatever the number of keys; more keys only let
more rows pass.  It meets the store's scan in a hash join on the block number, below
any exchange: rows whose key cannot be in the batch are never shuffled.  What passes
meets the keys in an exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.session import free_names

WORDS = 8
BLOCKS = 1 << 14  # one megabyte of bits: 500,000 keys at 16 bits each
LEAST_BLOCKS, MOST_BLOCKS = 1 << 8, 1 << 18


def blocks_for(rows: int) -> int:
    """Blocks that give each of ``rows`` keys 16 bits, within the bounds."""
    blocks = LEAST_BLOCKS
    while blocks < MOST_BLOCKS and blocks * 64 * WORDS < 16 * rows:
        blocks *= 2
    return blocks


def _block(key: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks))


def _bit(key: list[str], word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(*key, F.lit(1)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def key_filter(keys: DataFrame, key: list[str], blocks: int = BLOCKS) -> DataFrame:
    """(block, w0 .. w7): the blocks that have bits set.  Bits are combined before
    the shuffle, so a key that a third of all rows share costs nothing."""
    return keys.groupBy(_block(key, blocks).alias("block")).agg(
        *[F.bit_or(_bit(key, j)).alias(f"w{j}") for j in range(WORDS)])


def might_hold(base: DataFrame, keys: DataFrame, key: list[str], flag: str, blocks: int = BLOCKS) -> DataFrame:
    """``base`` with the boolean ``flag``: false only if the key is not in ``keys``."""
    names = free_names(base.columns, ["block", *[f"w{j}" for j in range(WORDS)]])
    held = key_filter(keys.select(*key), key, blocks).toDF(*names)
    hit = reduce(Column.__and__, (F.col(names[j + 1]).bitwiseAND(_bit(key, j)) != 0 for j in range(WORDS)))
    joined = base.join(F.broadcast(held), _block(key, blocks) == F.col(names[0]), "left")
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def lookup(base: DataFrame, keys: DataFrame, key: list[str], blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``base`` whose key is in ``keys``; null keys match nothing."""
    flag, = free_names(base.columns, ["might"])
    near = might_hold(base, keys, key, flag, blocks).where(F.col(flag)).drop(flag)
    return near.join(keys.select(*key).distinct(), key, "left_semi")
