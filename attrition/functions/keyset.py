"""A key set of bounded size that drops rows before a shuffle.

``key_set`` folds the hashes of the wanted keys into a bit map: 64-bit words, at
most ``2^(bits - 6)`` of them however many keys there are, so it may be broadcast
(2^21 rows with the default). ``in_key_set`` keeps every row whose key is wanted
and a few others whose hash shares a bit: use it where surplus rows change cost
only, not results. With many more keys than bits it keeps nearly all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27


def _bit(keys: list[str], bits: int) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(2**bits - 1))


def key_set(df: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``_word, _mask``: the set of the ``keys`` of ``df``."""
    one = F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")
    return df.select(_bit(keys, bits).alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(one).alias("_mask"))


def in_key_set(df: DataFrame, keys: list[str], wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose ``keys`` may be in the set ``wanted``."""
    x = df.withColumn("_bit", _bit(keys, bits)).withColumn("_word", F.shiftright("_bit", 6))
    hit = F.expr("shiftright(_mask, CAST(_bit & 63 AS INT)) & 1L") == 1
    return x.join(F.broadcast(wanted), "_word").filter(hit).drop("_bit", "_word", "_mask")
