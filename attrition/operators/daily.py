"""User-day building blocks: daily counts, artist entropy, dense spine,
cumulative and rolling windows.

Shuffle plan (training spine):

* events -> ``groupBy(userId, date, artist)`` with partial aggregation ->
  ``groupBy(userId, date)``: counts, entropy and dimensions from one scan (a
  hot user is spread over its days and artists);
* the user-day table moves once more, to ``userId``: gap filling and every
  per-user window run on that partitioning. A user holds one row per
  calendar day there, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import PAGES


def _count() -> Column:
    return F.count(F.lit(1))


def _keyed(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("userId").isNotNull() & F.col("date").isNotNull())


def daily_aggregates(ev: DataFrame) -> DataFrame:
    """``userId, date, events, listen_sec, <11 page counts>`` for every
    active user-day, in one aggregate. ``listen_sec`` is 0 when the day has
    no length at all (sum of nulls is null)."""
    page = F.col("page")
    return _keyed(ev).groupBy("userId", "date").agg(
        _count().alias("events"),
        F.coalesce(F.sum("length"), F.lit(0.0)).alias("listen_sec"),
        *[F.count_if(page == p).alias(p) for p in PAGES],
    )


def daily_aggregates_with_dims(ev: DataFrame) -> DataFrame:
    """``daily_aggregates`` with ``artist_entropy_day`` and per-day pieces of the
    user dimensions, from one scan: events are aggregated by user, day and
    artist, and those rows rolled up to the day. The pieces are the earliest
    registration of the day, and the day's first event (by time, and by log
    order) as a decimal key tagged with the event's gender code + 1
    (``key_tag``). Rolled up to the user with windows later, so no separate
    user aggregate or join is needed. Events without a time make one row per
    user with a null date: it counts for the user's registration, and
    ``densify`` drops it."""
    from attrition.functions.expr import gender_code
    from attrition.functions.sequence import tagged_order_key, tagged_seq_key

    tag = gender_code("gender") + F.lit(1)
    page = F.col("page")
    first = {"_reg_day": F.col("registration_datetime"), "_first_by_time": tagged_order_key(tag), "_first_by_seq": tagged_seq_key(tag)}
    by_artist = ev.filter(F.col("userId").isNotNull()).groupBy("userId", "date", "artist").agg(
        _count().alias("events"),
        F.sum("length").alias("listen_sec"),
        *[F.count_if(page == p).alias(p) for p in PAGES],
        *[F.min(c).alias(name) for name, c in first.items()],
    )
    plays = F.when(F.col("artist").isNotNull(), F.col("events").cast("double"))
    days = by_artist.groupBy("userId", "date").agg(
        F.sum("events").alias("events"),
        F.coalesce(F.sum("listen_sec"), F.lit(0.0)).alias("listen_sec"),
        *[F.sum(f"`{p}`").alias(p) for p in PAGES],
        *[F.min(name).alias(name) for name in first],
        F.sum(plays).alias("_n"),
        F.sum(plays * F.log2(plays)).alias("_s"),
    )
    return days.withColumn("artist_entropy_day", F.coalesce(F.log2("_n") - F.col("_s") / F.col("_n"), F.lit(0.0))).drop("_n", "_s")


def user_activity_bounds(ev: DataFrame) -> DataFrame:
    return _keyed(ev).groupBy("userId").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def artist_counts(ev: DataFrame) -> DataFrame:
    return (
        _keyed(ev)
        .filter(F.col("artist").isNotNull())
        .groupBy("userId", "date", "artist")
        .agg(_count().alias("cnt"))
    )


def share_of_day(ev: DataFrame) -> DataFrame:
    """Each artist's share of the user's plays that day (count / day total).
    The total is an aggregate joined back, so a busy user-day is no single task."""
    ac = artist_counts(ev)
    total = ac.groupBy("userId", "date").agg(F.sum("cnt").alias("_total"))
    return ac.join(total, ["userId", "date"]).withColumn("p", F.col("cnt") / F.col("_total")).drop("_total")


def artist_entropy(ev: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of the artist distribution per user-day.

    ``H = log2(N) - sum(c * log2 c) / N`` over the artist counts ``c`` of the
    day (``N = sum c``) - equal to ``-sum(p log2 p)`` but needs only two
    aggregates, so a busy user-day is reduced map-side like any other."""
    ac = artist_counts(ev)
    c = F.col("cnt").cast("double")
    agg = ac.groupBy("userId", "date").agg(F.sum(c).alias("_n"), F.sum(c * F.log2(c)).alias("_s"))
    return agg.select("userId", "date", (F.log2("_n") - F.col("_s") / F.col("_n")).alias("artist_entropy_day"))


def densify(days: DataFrame, end_col: str, fill_cols: list[str], fill_zero: dict[str, Column] | None = None) -> DataFrame:
    """Dense per-user daily rows from a sparse user-day table.

    ``days`` has one row per active ``(userId, date)`` and a per-user
    ``end_col`` (last day of the spine). Rows after the end are dropped; the
    empty days between two active days (and after the last one up to the
    end) are generated by exploding ``sequence(date, stop)`` on each active
    row, where ``stop`` is the day before the next active day. Generated
    days carry 0 in ``fill_cols``. No calendar table and no join: one
    window over the user's active days."""
    fill_zero = fill_zero or {}
    w = Window.partitionBy("userId").orderBy("date")
    end = F.col(end_col)
    x = days.filter(F.col("date") <= end)
    nxt = F.lead("date").over(w)
    x = x.withColumn("_stop", F.least(F.coalesce(F.date_sub(nxt, 1), end), end))
    x = x.withColumn("_day", F.explode(F.sequence(F.col("date"), F.col("_stop"))))
    active = F.col("_day") == F.col("date")
    cols = []
    for c in x.columns:
        if c in ("date", "_stop", "_day"):
            continue
        if c in fill_cols:
            cols.append(F.when(active, F.col(c)).otherwise(fill_zero.get(c, F.lit(0))).alias(c))
        else:
            cols.append(F.col(c))
    return x.select(F.col("_day").alias("date"), *cols)


def window_sums(dense: DataFrame, cols: list[str], recent: int, long: int) -> DataFrame:
    """``cum_<c>``, ``win<recent>_<c>``, ``win<long>_<c>``: running and
    trailing-row sums per user over the dense daily rows (rows are days, so
    a row frame is a day frame). All share one window operator; the 3 x 13
    expressions are handed to Spark as one SQL projection."""
    spec = "PARTITION BY userId ORDER BY date ROWS BETWEEN {} AND CURRENT ROW"
    frames = {
        "cum_": spec.format("UNBOUNDED PRECEDING"),
        f"win{recent}_": spec.format(f"{recent - 1} PRECEDING"),
        f"win{long}_": spec.format(f"{long - 1} PRECEDING"),
    }
    exprs = [f"sum(`{c}`) OVER ({frame}) AS `{prefix}{c}`" for c in cols for prefix, frame in frames.items()]
    return dense.selectExpr("*", *exprs)

