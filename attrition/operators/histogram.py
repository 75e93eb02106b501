"""Equal-width histogram with numpy's binning rules.

Edges are ``lo + i * (hi - lo) / n`` (the last edge is ``hi`` itself); the
last bin is closed on the right; a constant column spans ``lo - 0.5 ..
hi + 0.5``. The bounds are a scalar subquery, so nothing runs while the query
is built; the counts are one aggregate keyed by bin, and empty bins come from a
join with ``range(n)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edge(i: Column, lo: Column, hi: Column, n: int) -> Column:
    step = (hi - lo) / F.lit(float(n))
    return F.when(i >= n, hi).otherwise(i.cast("double") * step + lo)


def histogram(df: DataFrame, column: str, n: int, weight: str | None = None) -> DataFrame:
    """``bin, lo, hi, count`` for ``n`` equal-width bins over the non-null
    values of ``column``; with ``weight``, a row counts that many times."""
    times = F.lit(1) if weight is None else F.col(weight)
    vals = df.select(F.col(column).cast("double").alias("x"), times.cast("long").alias("w")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    bounds = vals.select(F.struct(F.min("x").alias("mn"), F.max("x").alias("mx"))).scalar()
    flat = F.when(bounds["mn"] == bounds["mx"], 0.5).otherwise(0.0)
    span = {"_lo": bounds["mn"] - flat, "_hi": bounds["mx"] + flat}
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("x")
    i0 = F.least(F.floor((x - lo) * (F.lit(float(n)) / (hi - lo))), F.lit(n - 1))
    i1 = F.when(x < _edge(i0, lo, hi, n), i0 - 1).otherwise(i0)
    i2 = F.when((x >= _edge(i1 + 1, lo, hi, n)) & (i1 != n - 1), i1 + 1).otherwise(i1)
    counts = vals.withColumns(span).groupBy(i2.cast("long").alias("bin")).agg(F.sum("w").alias("count"))
    bins = df.sparkSession.range(n).withColumnRenamed("id", "bin").withColumns(span).filter(lo.isNotNull())
    i = F.col("bin")
    return bins.join(counts, "bin", "left").select(
        "bin",
        _edge(i, lo, hi, n).alias("lo"),
        _edge(i + 1, lo, hi, n).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )
