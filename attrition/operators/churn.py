"""Churn detection and churn analytics.

A churn event is a ``Submit Downgrade`` whose previous event (same user, time
order) was on the paid level and whose next event is on the free level. A
missing neighbour compares false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import CHURN_PAGE, SUBSCRIBE_PAGE, WEEKDAY_NAMES
from attrition.functions.bitset import bit_sets, count_sets
from attrition.functions.expr import DAY_MICROS, floor_days
from attrition.functions.keyset import in_key_set, key_set
from attrition.functions.sequence import global_rank, hour_of, order_cols, order_key, sequence_view, tagged_order_key


ORDER_INPUT = ("event_seq", "userId", "datetime")
NEIGHBOUR_INPUT = (*ORDER_INPUT, "sessionId", "page", "level", "auth", "status", "location", "gender")


def with_level_neighbours(ev: DataFrame) -> DataFrame:
    """Events of non-null users with ``rn``, ``n_part``, ``prev_level``,
    ``next_level`` (skew-safe, see ``functions.sequence``)."""
    return sequence_view(ev.select([c for c in ev.columns if c in NEIGHBOUR_INPUT]), "userId", ("level",))


def is_churn() -> Column:
    return (
        (F.col("page") == CHURN_PAGE)
        & F.coalesce(F.col("prev_level") == "paid", F.lit(False))
        & F.coalesce(F.col("next_level") == "free", F.lit(False))
    )


def level_code() -> Column:
    """What churn detection needs of a level, as a number: paid -> 1,
    free -> 0, any other level -> 2, null -> null. Numbers keep the
    per-bucket summary of the sequence view a hash aggregate."""
    lv = F.col("level")
    return F.when(lv == "paid", F.lit(1)).when(lv == "free", F.lit(0)).when(lv.isNotNull(), F.lit(2))


def with_level_code_neighbours(ev: DataFrame, extra: tuple[str, ...] = (), counters: dict | None = None, keep_level: bool = False) -> DataFrame:
    """``with_level_neighbours`` carrying ``prev_level_code`` /
    ``next_level_code`` instead of the level text (plus ``extra``
    neighbour columns and ``counters``)."""
    coded = ev.withColumn("level_code", level_code())
    return sequence_view(coded if keep_level else coded.drop("level"), "userId", ("level_code", *extra), counters=counters)


def is_churn_coded() -> Column:
    """``is_churn`` on the level codes."""
    return (
        (F.col("page") == CHURN_PAGE)
        & F.coalesce(F.col("prev_level_code") == 1, F.lit(False))
        & F.coalesce(F.col("next_level_code") == 0, F.lit(False))
    )


def level_neighbours(ev: DataFrame) -> DataFrame:
    seq = sequence_view(ev.select(*ORDER_INPUT, "level"), "userId", ("level",))
    return seq.select("event_seq", "userId", "datetime", "level", "prev_level", "next_level")


CHURN_EVENT_COLUMNS = ["event_seq", "datetime", "userId", "sessionId", "page", "level", "prev_level", "next_level",
                       "auth", "status", "location", "gender"]


def churn_candidates(ev: DataFrame) -> DataFrame:
    """The churn events with all columns of ``ev``, found from the
    ``Submit Downgrade`` rows instead of numbering the whole log:

    1. only events in the same (user, hour) as a candidate are shuffled, and a
       window there gives the candidate its neighbours; a candidate whose
       neighbour there contradicts churn goes;
    2. a candidate at the edge of its hour takes its neighbour from the first and
       last level of the user's other hours. Only users with such a candidate
       send these, one row an hour and input partition.

    The log is read once to find the candidates, once for each step (narrow
    columns) and shuffled in small part (``functions.keyset`` drops the rest
    before). No user's events meet in one task beyond an hour of them."""
    keys = ["userId", "_bucket"]
    log = ev.filter(F.col("userId").isNotNull()).withColumns({"_bucket": hour_of("datetime", "event_seq"), "_code": level_code()})
    candidate = F.col("page") == CHURN_PAGE
    near = in_key_set(log, keys, key_set(log.filter(candidate), keys))

    w = Window.partitionBy(*keys).orderBy(*order_cols())
    seen = near.withColumns({
        "_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull(),
        "_prev": F.lag("_code").over(w), "_next": F.lead("_code").over(w),
    }).filter(candidate)
    seen = seen.filter((F.col("_first") | (F.col("_prev") == 1)) & (F.col("_last") | (F.col("_next") == 0)))

    edge = key_set(seen.filter(F.col("_first") | F.col("_last")), ["userId"])
    okey, user = tagged_order_key(F.lit(0)), Window.partitionBy("userId").orderBy("_bucket")
    hours = in_key_set(log.select(*ORDER_INPUT, "page", "_bucket", "_code"), ["userId"], edge).groupBy(*keys).agg(
        F.min_by("_code", okey).alias("_head"), F.max_by("_code", okey).alias("_tail"), F.max(F.coalesce(candidate, F.lit(False))).alias("_asked")
    )
    hours = hours.withColumns({"_before": F.lag("_tail").over(user), "_after": F.lead("_head").over(user)}).filter("_asked")
    out = seen.join(hours.select(*keys, "_before", "_after"), keys, "left")
    prev = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    following = F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))
    return out.filter((prev == 1) & (following == 0)).select(*ev.columns)


#: From this estimated size of the input on, neighbours are looked up for the candidates only.
LARGE_LOG_BYTES = 32 * 2**20


def is_large(ev: DataFrame, limit: int | None = None) -> bool:
    """Whether Spark's own estimate of the input (the one it picks joins by) reaches ``limit``."""
    size = int(str(ev._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size >= (LARGE_LOG_BYTES if limit is None else limit)


def churn_events(ev: DataFrame, limit: int | None = None) -> DataFrame:
    """The churn events with their display columns (``location`` only when
    the event frame carries it).

    A log of ``limit`` estimated bytes (default ``LARGE_LOG_BYTES``) and more goes by
    ``churn_candidates``, whose extra scans save nearly all of the shuffle; a smaller
    one is numbered in one scan. The rows are the same. By definition a churn event's
    neighbours are ``paid`` and ``free``; ``assert_churn_meaning`` looks at them."""
    x = ev.select([c for c in ev.columns if c in NEIGHBOUR_INPUT])
    if is_large(x, limit):
        found = churn_candidates(x).withColumns({"prev_level": F.lit("paid"), "next_level": F.lit("free")})
    else:
        found = with_level_neighbours(x).filter(is_churn())
    return found.select([c for c in CHURN_EVENT_COLUMNS if c in found.columns])


def churn_timestamps(ev: DataFrame, limit: int | None = None) -> DataFrame:
    """First churn time per user: ``userId, churn_ts, churn_date`` (by either way of ``churn_events``)."""
    x = ev.select(*ORDER_INPUT, "page", "level")
    found = churn_candidates(x) if is_large(x, limit) else with_level_code_neighbours(x).filter(is_churn_coded())
    return found.groupBy("userId").agg(F.min("datetime").alias("churn_ts")).withColumn("churn_date", F.to_date("churn_ts"))


def churn_summary(ev: DataFrame) -> DataFrame:
    """Churn events, churned users, all users, churned share."""
    ce = churn_events(ev).agg(
        F.count(F.lit(1)).alias("churn_events"), F.count_distinct("userId").alias("churned_users")
    )
    total = ev.select(F.count_distinct("userId")).scalar()  # scalar subquery, no join
    return ce.select("churn_events", "churned_users", total.alias("total_users")).select(
        "churn_events", "churned_users", "total_users",
        F.try_divide(F.col("churned_users").cast("double"), F.col("total_users")).alias("churned_share"),
    )


def flag_churned_users(ev: DataFrame, churn_ts: DataFrame) -> DataFrame:
    """Events with ``is_churned_user`` (semi-join as a boolean)."""
    churned = churn_ts.select("userId", F.lit(True).alias("_c"))
    return ev.join(churned, "userId", "left").withColumn(
        "is_churned_user", F.coalesce(F.col("_c"), F.lit(False))
    ).drop("_c")


def first_activity(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("userId").isNotNull()).groupBy("userId").agg(F.min("datetime").alias("first_activity"))


def time_to_churn(ev: DataFrame, churn_ts: DataFrame | None = None) -> DataFrame:
    """Floor days from first activity to first churn, churned users only."""
    churn_ts = churn_timestamps(ev) if churn_ts is None else churn_ts
    return (
        churn_ts.join(first_activity(ev), "userId", "inner")
        .select("userId", floor_days("churn_ts", "first_activity").alias("time_to_churn_days"))
    )


def time_to_churn_stats(ttc: DataFrame) -> DataFrame:
    x = F.col("time_to_churn_days")
    return ttc.agg(
        F.median(x).cast("double").alias("median_days"),
        F.avg(x).alias("mean_days"),
        F.min(x).alias("min_days"),
        F.max(x).alias("max_days"),
    )


def resubscribe(ev: DataFrame, churn_ts: DataFrame | None = None) -> DataFrame:
    """Churned users who came back: first ``Submit Upgrade`` before the first
    churn, first one after it, and whole days between churn and return."""
    churn_ts = churn_timestamps(ev) if churn_ts is None else churn_ts
    ups = ev.filter(F.col("page") == SUBSCRIBE_PAGE).select("userId", "datetime")
    t, c = F.col("datetime"), F.col("churn_ts")
    out = (
        ups.join(churn_ts.select("userId", "churn_ts"), "userId", "inner")
        .groupBy("userId", "churn_ts")
        .agg(F.min(F.when(t < c, t)).alias("first_subscribe"), F.min(F.when(t > c, t)).alias("first_resubscribe"))
        .filter(F.col("first_resubscribe").isNotNull())
    )
    return out.select(
        "userId",
        "first_subscribe",
        F.col("churn_ts").alias("churn_date"),
        "first_resubscribe",
        floor_days("first_resubscribe", "churn_ts").alias("days_between_churn_and_resubscribe"),
    )


def resubscribe_summary(resub: DataFrame) -> DataFrame:
    return resub.agg(
        F.count_distinct("userId").alias("unique_users_resubscribed"),
        F.count(F.lit(1)).alias("total_resubscribe_events"),
    )


def _active_by(ev: DataFrame, key: Column, name: str) -> DataFrame:
    users = ev.filter(key.isNotNull()).select(key.alias(name), "userId")
    return count_sets(bit_sets(users, [name], "userId"), [name], "active_users")


def _churned_by(churn_ts: DataFrame, key: Column, name: str) -> DataFrame:
    return churn_ts.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("churned_users"))


def _rate(churned: Column, active: Column) -> Column:
    return F.coalesce(F.try_divide(churned.cast("double"), active) * 100.0, F.lit(0.0))


def daily_churn_rate(ev: DataFrame, churn_ts: DataFrame, churn_days_only: bool = False) -> DataFrame:
    """Share of a day's active users whose first churn fell on that day, in
    percent; days without churn are 0 (or, with ``churn_days_only``, absent)."""
    active = _active_by(ev, F.to_date("datetime"), "date")
    churned = _churned_by(churn_ts, F.to_date("churn_ts"), "date")
    how = "inner" if churn_days_only else "left"
    out = active.join(churned, "date", how)
    return out.select(
        "date",
        "active_users",
        F.coalesce(F.col("churned_users"), F.lit(0)).alias("churned_users"),
        _rate(F.col("churned_users"), F.col("active_users")).alias("churn_rate"),
    )


def churn_rate_by_dom(ev: DataFrame, churn_ts: DataFrame) -> DataFrame:
    active = _active_by(ev, F.dayofmonth("datetime"), "day_of_month")
    churned = _churned_by(churn_ts, F.dayofmonth("churn_ts"), "day_of_month")
    out = active.join(churned, "day_of_month", "full")
    return out.select(
        F.col("day_of_month").cast("long").alias("day_of_month"),
        _rate(F.col("churned_users"), F.col("active_users")).alias("churn_rate"),
    )


def churn_rate_by_dow(ev: DataFrame, churn_ts: DataFrame) -> DataFrame:
    """All seven weekdays, Monday first (``day_of_week`` 1..7)."""
    spark = ev.sparkSession
    days = spark.range(1, 8).select(
        F.col("id").alias("day_of_week"),
        F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_NAMES]), F.col("id").cast("int")).alias("day_name"),
    )
    active = _active_by(ev, (F.weekday("datetime") + 1).cast("long"), "day_of_week")
    churned = _churned_by(churn_ts, (F.weekday("churn_ts") + 1).cast("long"), "day_of_week")
    out = days.join(active, "day_of_week", "left").join(churned, "day_of_week", "left")
    return out.select("day_of_week", "day_name", _rate(F.col("churned_users"), F.col("active_users")).alias("churn_rate"))


def first_row_values(ev: DataFrame, cols: list[str]) -> DataFrame:
    """Per user, the values of ``cols`` on the user's first event by time
    (a null value on that event counts)."""
    okey = order_key()
    return ev.filter(F.col("userId").isNotNull()).groupBy("userId").agg(
        *[F.min_by(c, okey).alias(c) for c in cols]
    )


def churn_by_gender(ev: DataFrame, churn_ts: DataFrame) -> DataFrame:
    """Users by first-event gender and churn flag; null gender dropped."""
    users = first_row_values(ev, ["gender"]).join(
        churn_ts.select("userId", F.lit(1).alias("_c")), "userId", "left"
    )
    churned = F.col("_c").isNotNull()
    return (
        users.filter(F.col("gender").isNotNull())
        .groupBy("gender")
        .agg(F.count_if(~churned).alias("not_churned"), F.count_if(churned).alias("churned"))
    )


def churn_context(ev: DataFrame, n_events: int = 3, radius: int = 5) -> DataFrame:
    """The ``radius`` events before and after each of the first ``n_events``
    churn events (ordered by user, then time), with a marker on the churn row.

    The churn rows are found on the narrow coded view; they are a top-k
    (``n_events`` rows), so broadcasting them is bounded by the parameter, and
    only their users' events are numbered with all columns."""
    coded = with_level_code_neighbours(ev.select(*ORDER_INPUT, "page", "level"))
    picked = (
        coded.filter(is_churn_coded())
        .orderBy(F.col("userId").asc(), *order_cols())
        .limit(n_events)
        .select(F.col("userId").alias("_u"), F.col("rn").alias("_crn"), F.col("datetime").alias("churn_at"), F.col("event_seq").alias("_cseq"))
    )
    picked = picked.withColumn("churn_no", F.row_number().over(Window.orderBy(F.col("_u"), F.col("_crn"))))  # at most n_events rows
    shown = ev.select(*ORDER_INPUT, "page", "level", "sessionId", "status", "auth")
    theirs = shown.join(F.broadcast(picked.select(F.col("_u").alias("userId")).distinct()), "userId", "left_semi")
    seq = sequence_view(theirs, "userId")
    near = (seq["userId"] == picked["_u"]) & seq["rn"].between(picked["_crn"] - radius, picked["_crn"] + radius)
    return seq.join(F.broadcast(picked), near, "inner").select(
        F.col("churn_no").cast("long").alias("churn_no"),
        "userId",
        "churn_at",
        "event_seq",
        "datetime",
        "page",
        "level",
        "sessionId",
        "status",
        "auth",
        (F.col("event_seq") == F.col("_cseq")).alias("is_churn_row"),
    )


def top_users(ev: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` users with most events (ties: smaller id first)."""
    return (
        ev.filter(F.col("userId").isNotNull())
        .groupBy("userId")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("events").desc(), F.col("userId").asc())
        .limit(k)
    )


def session_timeline(ev: DataFrame, k: int = 10, palette: int = 20) -> DataFrame:
    """Events of the ``k`` most active users with the user's rank and a
    session colour index (sessions numbered in first-seen time order,
    modulo ``palette``)."""
    top = top_users(ev, k).select(
        "userId", (F.row_number().over(Window.orderBy(F.col("events").desc(), F.col("userId").asc())) - 1).alias("user_rank")
    )  # k rows
    subset = ev.join(F.broadcast(top), "userId", "inner")
    # a decimal key keeps this a hash aggregate; its days are the buckets of the ranking
    sessions = subset.groupBy("sessionId").agg(F.min(tagged_order_key(F.lit(0))).alias("_first"))
    ranked = global_rank(
        sessions, bucket=F.floor(F.col("_first").cast("double") / (DAY_MICROS * 1e20)).cast("long"), ordering=[F.col("_first")]
    ).select("sessionId", ((F.col("grank") - 1) % palette).alias("session_color"))
    return subset.join(ranked, "sessionId", "inner").select(
        "userId", F.col("user_rank").cast("long").alias("user_rank"), "event_seq", "datetime", "sessionId",
        F.col("session_color").cast("long").alias("session_color"),
    )


def assert_churn_meaning(ev: DataFrame) -> DataFrame:
    """Churn events whose neighbours, looked up anew in the numbered log,
    contradict the definition (must be 0)."""
    found = churn_events(ev).select("event_seq", "userId")
    looked_up = with_level_neighbours(ev).select("event_seq", "userId", "prev_level", "next_level")
    ce = found.join(looked_up, ["event_seq", "userId"], "left")
    good = (F.col("prev_level") == "paid") & (F.col("next_level") == "free")
    return ce.agg(F.count(F.lit(1)).alias("churn_events"), F.count_if(~F.coalesce(good, F.lit(False))).alias("violations"))
