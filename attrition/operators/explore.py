"""Exploratory aggregates over the event log.

Each function is DataFrame in, DataFrame out, one aggregate per question.
Null group keys are dropped (pandas ``groupby`` semantics) except where
noted; distinct counts ignore nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.config import PAGES
from attrition.functions.bitset import bit_sets, count_sets
from attrition.functions.expr import browser, day_of_week, floor_days, minutes_between, operating_system
from attrition.session import checkpoint_dir


def _count() -> Column:
    return F.count(F.lit(1))


def events_profile(ev: DataFrame) -> DataFrame:
    """Row count, unique users and null timestamps (one row)."""
    return ev.agg(
        _count().alias("rows"),
        F.count_distinct("userId").alias("unique_users"),
        F.count_if(F.col("datetime").isNull()).alias("null_timestamps"),
    )


def total_unique_users(ev: DataFrame) -> DataFrame:
    return ev.agg(F.count_distinct("userId").alias("total_users"))


def _distinct_by(ev: DataFrame, key: Column, name: str, what: str, alias: str) -> DataFrame:
    sets = bit_sets(ev.filter(key.isNotNull()).select(key.alias(name), what), [name], what)
    return count_sets(sets, [name], alias)


def active_users_per_day(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.col("date"), "date", "userId", "active_users")


def sessions_per_day(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.col("date"), "date", "sessionId", "sessions")


def users_and_sessions_per_day(ev: DataFrame) -> DataFrame:
    """Both daily series side by side from one aggregate (no join)."""
    return ev.filter(F.col("date").isNotNull()).groupBy("date").agg(
        F.count_distinct("userId").alias("active_users"), F.count_distinct("sessionId").alias("sessions")
    )


def sessions_by_hour(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.hour("datetime").cast("long"), "hour", "sessionId", "sessions")


def session_durations(ev: DataFrame) -> DataFrame:
    """(max - min) event time per session, in minutes. The session key is
    ``sessionId`` alone."""
    agg = ev.filter(F.col("sessionId").isNotNull()).groupBy("sessionId").agg(F.min("datetime").alias("_first"), F.max("datetime").alias("_last"))
    return agg.select("sessionId", minutes_between("_last", "_first").alias("session_duration_min"))


def session_sizes(ev: DataFrame) -> DataFrame:
    """Duration in minutes and number of events of each session."""
    agg = ev.filter(F.col("sessionId").isNotNull()).groupBy("sessionId").agg(
        F.min("datetime").alias("_first"), F.max("datetime").alias("_last"), _count().alias("events")
    )
    return agg.select("sessionId", minutes_between("_last", "_first").alias("session_duration_min"), "events")


def session_duration_join(ev: DataFrame) -> DataFrame:
    """Every event with its session's duration. The per-session aggregate is
    joined back (not a window over the session) so a hot session is split by
    AQE's skew-join handling instead of landing in one task."""
    return ev.join(session_durations(ev), "sessionId", "left")


def events_by_gender(ev: DataFrame) -> DataFrame:
    """Events per gender; the null gender is kept as a group."""
    return ev.groupBy("gender").agg(_count().alias("events"))


def users_by_gender(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.col("gender"), "gender", "userId", "users")


def page_counts(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("page").isNotNull()).groupBy("page").agg(_count().alias("events"))


#: Most levels that a pivot names as columns.
MAX_LEVELS = 1000


def page_level_counts(ev: DataFrame) -> DataFrame:
    """Events per page and level, one row each: the one pass over the log that the
    pivots need. Checkpointed, as the levels name the columns of the result."""
    checkpoint_dir(ev.sparkSession)
    return ev.filter(F.col("page").isNotNull() & F.col("level").isNotNull()).groupBy("page", "level").agg(_count().alias("n")).checkpoint()


def _levels(counts: DataFrame) -> list[str]:
    """The levels that occur, in order; refuses more than ``MAX_LEVELS``."""
    found = [r.level for r in counts.select("level").distinct().orderBy("level").limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels: pass the ones to show")
    return found


def page_by_level(ev: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Pivot page x level with zero fill, plus the row total over the levels
    (default: all that occur in the data)."""
    counts = page_level_counts(ev)
    levels = _levels(counts) if levels is None else levels
    lv = F.col("level")
    return (
        counts.filter(lv.isin(*levels))
        .groupBy("page")
        .agg(*[F.coalesce(F.sum(F.when(lv == x, F.col("n"))), F.lit(0)).alias(x) for x in levels])
        .withColumn("total", sum((F.col(f"`{x}`") for x in levels), F.lit(0)))
    )


def page_by_level_pct(ev: DataFrame, levels: list[str] | None = None) -> DataFrame:
    pv = page_by_level(ev, levels)
    return pv.select("page", *[(F.col(f"`{x}`") / F.col("total") * 100.0).alias(f"{x}_pct") for x in pv.columns[1:-1]])


def sessions_per_user(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.col("userId"), "userId", "sessionId", "sessions")


def devices_per_user(ev: DataFrame) -> DataFrame:
    return _distinct_by(ev, F.col("userId"), "userId", "userAgent", "devices")


def avg_session_hours_per_user(ev: DataFrame) -> DataFrame:
    """Event-weighted mean session duration of the user, floor-divided by 60.
    Events are counted per user and session first; durations join that table."""
    per = ev.filter(F.col("userId").isNotNull()).groupBy("userId", "sessionId").agg(_count().alias("_n"))
    d = F.col("session_duration_min")
    sums = per.join(session_durations(ev), "sessionId", "left").groupBy("userId").agg(
        F.sum(F.col("_n") * d).alias("_s"), F.sum(F.when(d.isNotNull(), F.col("_n"))).alias("_c")
    )
    return sums.select("userId", F.floor(F.try_divide(F.col("_s"), F.col("_c").cast("double")) / 60.0).cast("double").alias("avg_session_hours"))


def top_values(ev: DataFrame, column: str, k: int = 10, alias: str = "events") -> DataFrame:
    """The ``k`` most frequent non-null values (ties: smaller value first).
    The limit is the feature (a top-k report)."""
    return (
        ev.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(_count().alias(alias))
        .orderBy(F.col(alias).desc(), F.col(column).asc())
        .limit(k)
    )


def top_locations(ev: DataFrame, k: int = 10) -> DataFrame:
    return top_values(ev, "location", k)


# --- per-event projections ------------------------------------------------

def enrich_calendar(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_seq",
        "date",
        F.hour("datetime").cast("long").alias("hour"),
        F.dayofmonth("datetime").cast("long").alias("day_of_month"),
        day_of_week("datetime").cast("long").alias("day_of_week"),
        F.date_format("datetime", "EEEE").alias("day_name"),
    )


def days_since_registration(ev: DataFrame) -> DataFrame:
    return ev.select("event_seq", floor_days("datetime", "registration_datetime").alias("days_since_registration"))


def parse_user_agent(ev: DataFrame) -> DataFrame:
    return ev.select("event_seq", "userAgent", browser("userAgent").alias("browser"), operating_system("userAgent").alias("os"))


def filter_pages(ev: DataFrame, pages: list[str] = PAGES) -> DataFrame:
    return ev.filter(F.col("page").isin(*pages))
