"""Exact sets of ids as 64-bit words, for distinct counts that merge.

``bit_sets`` folds the ids of a group into words: id ``i`` is bit ``i mod 64`` of word
``i div 64``. A word is one row, so a group of few ids has few rows (never more than
ids) and a large set of neighbouring ids 64 times fewer than ids. ``bit_or`` of a long
runs in Spark's hash aggregate and partially before the shuffle, and a hot group is
spread over its words. Sets of days or sessions merge to sets of longer spans with
``merge_sets`` without a look at the events.

Integers are ids themselves; a text is the id it spells in plain decimal form
(``'17'``, not ``'017'``). Any other text keeps a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET_COLUMNS = ["_word", "_other", "_mask"]


def word_of(i: Column) -> Column:
    return F.shiftright(i, 6)


def bit_of(i: Column) -> Column:
    """A long with the id's bit set; null for a null id."""
    return F.call_function("shiftleft", F.when(i.isNotNull(), F.lit(1).cast("long")), i.bitwiseAND(F.lit(63)).cast("int"))


def known_bit(value: str, known: list[str]) -> Column:
    """The bit of a text's place in ``known`` (at most 63 texts); null elsewhere."""
    if len(known) > 63:
        raise ValueError("known_bit takes at most 63 texts")
    place = F.array_position(F.array(*[F.lit(v) for v in known]), F.col(value)).cast("long")
    return bit_of(F.nullif(place, F.lit(0).cast("long")))


def _id_and_other(df: DataFrame, value: str) -> tuple[Column, Column]:
    c = F.col(value)
    if df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long"):
        return c.cast("long"), F.lit(None).cast("string")
    text = c.cast("string")
    i = text.try_cast("long")
    i = F.when(i.cast("string") == text, i)
    return i, F.when(i.isNull(), text)


def bit_sets(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by..., _word, _other, _mask``: the set of non-null values of each group. A group
    of nulls only has one row, of an empty set."""
    i, other = _id_and_other(df, value)
    x = df.select(*by, word_of(i).alias("_word"), other.alias("_other"), bit_of(i).alias("_mask"))
    return merge_sets(x, by)


def merge_sets(sets: DataFrame, by: list[str]) -> DataFrame:
    """The unions of ``sets`` over coarser groups ``by``."""
    return sets.groupBy(*by, "_word", "_other").agg(F.bit_or("_mask").alias("_mask"))


def row_size() -> Column:
    """How many values a row of a set holds."""
    return F.coalesce(F.bit_count("_mask").cast("long"), F.col("_other").isNotNull().cast("long"))


def count_sets(sets: DataFrame, by: list[str], alias: str) -> DataFrame:
    """``by..., alias``: the sizes of sets whose rows are merged by ``by``."""
    return sets.groupBy(*by).agg(F.sum(row_size()).alias(alias))
