"""Train / validation splits.

``stratified_split`` orders the rows of each class by a hash of their key
(``md5`` of ``userId|date|seed``) and cuts each class at exact counts, so every
part holds the same share of every class; a re-run gives the same split. The
ranking is done in hash buckets with prefix sums, not in one task per class.
``time_split`` keeps the last ``test_days`` calendar days for testing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.sequence import global_rank


def unit_hash(*cols: str, seed: int = 42) -> Column:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


TWO_WAY = (("train", 0.7), ("validation", 0.3))
THREE_WAY = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
HASH_BUCKETS = 4096


def stratified_split(df: DataFrame, label: str, parts: tuple[tuple[str, float], ...] = TWO_WAY, seed: int = 42,
                     key_cols: tuple[str, ...] = ("userId", "date")) -> DataFrame:
    """Adds ``split``. Of a class with n rows the parts end at the ranks
    ``round(n * cumulated share)`` (halves up); a null label is a class."""
    u = unit_hash(*key_cols, seed=seed)
    x = df.withColumns({"_u": u, "_class": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    ranked = global_rank(x, F.floor(F.col("_u") * HASH_BUCKETS), [F.col("_u"), *map(F.col, key_cols)], ["_class"])
    ranked = ranked.join(x.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")), "_class")
    split, share = F.when(F.lit(False), ""), 0.0
    for name, part in parts[:-1]:
        share += part
        split = split.when(F.col("grank") <= F.floor(F.col("_n") * share + 0.5), name)
    return ranked.select(*df.columns, split.otherwise(parts[-1][0]).alias("split"))


def time_split(df: DataFrame, test_days: int = 1, date_col: str = "date") -> DataFrame:
    """Adds ``split``: rows after ``max(date) - test_days`` are ``test``.
    The global maximum is a scalar subquery (no join, no collect)."""
    last = df.select(F.max(date_col)).scalar()
    cutoff = F.date_sub(last, test_days)
    return df.withColumn("split", F.when(F.col(date_col) <= cutoff, F.lit("train")).otherwise(F.lit("test")))
