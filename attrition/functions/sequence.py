"""Per-user event order without putting a whole user into one task.

The original program sorts each user's events by time and takes positions,
previous/next values and row numbers. A plain ``Window.partitionBy(user)``
sends every event of a user to one task, and one user (the blank ``''`` id,
say) may own a third of the log. Here every user's timeline is cut into hours,
whatever its length:

1. events are shuffled once, to ``(user, hour)``; a window there gives local
   positions and neighbours;
2. each (user, hour) becomes one summary row (count, first and last value),
   from the same exchange, and a window over ``user`` places the hours.

The offsets come back by a join on ``(user, hour)``. So an event crosses the
network once, and a (user, hour) twice more as one row. The summary branch is
made to need the same columns as the event branch, so Spark reuses the event
exchange and reads the log once. What one task sorts (and spills) is one user's
hour.

Order is ``(datetime, event_seq)`` with null times last, matching a stable
sort by time in file order. Events without a time have ranges of the sequence
number for hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_BUCKET = 2**61  # null timestamps sort after every real bucket


def order_cols(time_col: str = "datetime", seq_col: str = "event_seq") -> list[Column]:
    return [F.col(time_col).asc_nulls_last(), F.col(seq_col).asc()]


def order_key(time_col: str = "datetime", seq_col: str = "event_seq") -> Column:
    """A struct that orders like ``order_cols`` (for min_by / max_by)."""
    return F.struct(F.col(time_col).isNull().alias("_tnull"), F.col(time_col).alias("_t"), F.col(seq_col).alias("_s"))


KEY_TYPE = "decimal(38,0)"
NULL_TIME_MICROS = 3 * 10**17  # later than 9999-12-31: null times sort last


def tagged_order_key(tag: Column, time_col: str = "datetime", seq_col: str = "event_seq") -> Column:
    """A decimal that orders like ``order_cols`` and carries a small tag
    (0..3) in its last digits: ``micros * 10^20 + seq * 4 + tag``.

    ``min`` / ``max`` of a decimal run in Spark's hash aggregate with
    generated code, where a struct key needs a sort-based aggregate;
    ``key_tag`` reads the tag of the extreme row back. Any 64-bit sequence
    number works: ``|seq * 4 + tag| < 10^20 / 2`` keeps distinct times
    apart, and ``micros * 10^20`` and ``seq * 4`` are multiples of 4."""
    micros = F.coalesce(
        F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{time_col}` AS TIMESTAMP_NTZ))"),
        F.lit(NULL_TIME_MICROS),
    )
    low = F.col(seq_col).cast(KEY_TYPE) * F.lit(4) + tag.cast(KEY_TYPE)
    return (micros.cast(KEY_TYPE) * F.expr(f"CAST('1{'0' * 20}' AS {KEY_TYPE})") + low).cast(KEY_TYPE)


def tagged_seq_key(tag: Column, seq_col: str = "event_seq") -> Column:
    """Like ``tagged_order_key`` for log order alone: ``seq * 4 + tag``."""
    return (F.col(seq_col).cast(KEY_TYPE) * F.lit(4) + tag.cast(KEY_TYPE)).cast(KEY_TYPE)


def key_tag(key: str | Column) -> Column:
    """The tag (0..3) carried by a tagged key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(k, F.lit(4).cast(KEY_TYPE)).cast("int")


def _epoch_seconds(time_col: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{time_col}` AS TIMESTAMP_NTZ))")


def hour_of(time_col: str, seq_col: str) -> Column:
    """Order-preserving bucket of an event: its hour. Without a time: ranges of
    2^16 sequence numbers after every real hour."""
    hour = F.floor(F.floor(_epoch_seconds(time_col)).cast("long") / F.lit(3600)).cast("long")
    return F.coalesce(hour, F.lit(NULL_BUCKET) + F.shiftright(F.col(seq_col).cast("long"), 16))


def sequence_view(
    df: DataFrame,
    part: str = "userId",
    neighbour_cols: tuple[str, ...] = (),
    time_col: str = "datetime",
    seq_col: str = "event_seq",
    bucket: Column | None = None,
    counters: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds ``rn`` (1-based position of the row in its ``part`` timeline),
    ``n_part`` (rows in the timeline) and, for every column in
    ``neighbour_cols``, ``prev_<c>`` / ``next_<c>`` (the value one row
    before / after within the timeline; null at the ends). For every
    ``counters`` entry ``name -> condition``: ``<name>_rn`` (rows so far,
    this one included, that meet the condition) and ``<name>_total``.

    Rows whose ``part`` is null are dropped: they belong to no timeline.
    ``bucket`` is an order-preserving image of the order (default
    ``hour_of``); any such image gives the same result. Pass only the columns
    that are used: both branches read all of ``df``.
    """
    counters = counters or {}
    names = list(counters)
    keys = [part, "_bucket"]
    flags = {f"_c_{n}": F.when(cond, F.lit(1)).otherwise(F.lit(0)) for n, cond in counters.items()}
    base = df.filter(F.col(part).isNotNull()).withColumns({"_bucket": hour_of(time_col, seq_col) if bucket is None else bucket, **flags})
    # true of every row; written out, since the join would add it to one branch only
    base = base.filter(F.col("_bucket").isNotNull()).repartition(*keys)

    local = Window.partitionBy(*keys).orderBy(*order_cols(time_col, seq_col))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols: dict[str, Column] = {"_lrn": F.row_number().over(local)}
    for n in names:
        local_cols[f"_lc_{n}"] = F.sum(f"_c_{n}").over(running)
    for c in neighbour_cols:
        local_cols[f"_lprev_{c}"] = F.lag(c).over(local)
        local_cols[f"_lnext_{c}"] = F.lead(c).over(local)
    x = base.withColumns(local_cols)

    # decimal order key: with numeric neighbour columns the summary is a
    # hash aggregate (a text column makes Spark fall back to sorting). The
    # checksum makes this branch need every column of the other one.
    okey = tagged_order_key(F.lit(0), time_col, seq_col)
    aggs = [F.count(F.lit(1)).alias("_bn"), F.bit_xor(F.xxhash64(*base.columns)).alias("_sum")]
    aggs += [F.sum(f"_c_{n}").alias(f"_bc_{n}") for n in names]
    for c in neighbour_cols:
        aggs += [F.min_by(c, okey).alias(f"_first_{c}"), F.max_by(c, okey).alias(f"_last_{c}")]
    hours = base.groupBy(*keys).agg(*aggs).filter(F.col("_sum").isNotNull())

    w, whole = Window.partitionBy(part).orderBy("_bucket"), Window.partitionBy(part)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = {"_start": F.coalesce(F.sum("_bn").over(before), F.lit(0)), "n_part": F.sum("_bn").over(whole)}
    for n in names:
        placed[f"_cstart_{n}"] = F.coalesce(F.sum(f"_bc_{n}").over(before), F.lit(0))
        placed[f"{n}_total"] = F.sum(f"_bc_{n}").over(whole)
    for c in neighbour_cols:
        placed[f"_prev_{c}"] = F.lag(f"_last_{c}").over(w)
        placed[f"_next_{c}"] = F.lead(f"_first_{c}").over(w)
    hours = hours.withColumns(placed).select(*keys, "_bn", *placed)

    out_cols: dict[str, Column] = {"rn": F.col("_start") + F.col("_lrn")}
    for n in names:
        out_cols[f"{n}_rn"] = F.col(f"_cstart_{n}") + F.col(f"_lc_{n}")
    for c in neighbour_cols:
        out_cols[f"prev_{c}"] = F.when(F.col("_lrn") == 1, F.col(f"_prev_{c}")).otherwise(F.col(f"_lprev_{c}"))
        out_cols[f"next_{c}"] = F.when(F.col("_lrn") == F.col("_bn"), F.col(f"_next_{c}")).otherwise(F.col(f"_lnext_{c}"))
    out = x.join(hours, keys, "inner").withColumns(out_cols)
    drop = ["_bucket", "_lrn", "_bn", "_start"]
    for n in names:
        drop += [f"_c_{n}", f"_lc_{n}", f"_cstart_{n}"]
    for c in neighbour_cols:
        drop += [f"_lprev_{c}", f"_lnext_{c}", f"_prev_{c}", f"_next_{c}"]
    return out.drop(*drop)


def global_rank(
    df: DataFrame,
    bucket: Column,
    ordering: list[Column],
    partition: list[str] | None = None,
) -> DataFrame:
    """Adds ``grank``: 1-based row number over ``ordering`` (within
    ``partition`` if given), computed without a single-task sort.

    ``bucket`` must be a coarse, order-preserving image of ``ordering``
    (for every two rows, a earlier than b implies bucket(a) <= bucket(b)).
    Rows are numbered inside each bucket in parallel; bucket sizes are
    prefix-summed over the (small) bucket table."""
    partition = partition or []
    keys = partition + ["_gb"]
    x = df.withColumn("_gb", bucket)
    x = x.withColumn("_glrn", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)))
    sizes = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gbn"))
    # the bucket table is small (one row per bucket), so an unpartitioned
    # window over it is cheap
    w = Window.partitionBy(*partition).orderBy("_gb") if partition else Window.orderBy("_gb")
    sizes = sizes.select(
        *keys, F.coalesce(F.sum("_gbn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_goff")
    )
    return x.join(sizes, keys, "inner").withColumn("grank", F.col("_goff") + F.col("_glrn")).drop("_gb", "_glrn", "_goff", "_gbn")
