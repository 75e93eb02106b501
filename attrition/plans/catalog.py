"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the benchmark tables through the event adapter, so its
work grows with them. Floating outputs are rounded to 6 places for the
cross-engine comparison (``round_doubles``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.functions.expr import round_doubles
from attrition.functions.sequence import global_rank
from attrition.operators import churn as C
from attrition.operators import explore as X
from attrition.operators.histogram import histogram
from attrition.session import checkpoint_dir
from attrition.sources.events import canonical, events_from_tables, load_events, write_event_log

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str, rounded: bool = True):
    def deco(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run

    return deco


def ev_keep(spark: SparkSession, sf_dir: str, location: bool = False) -> DataFrame:
    """Production view: the blank user id is an ordinary user. ``location``
    (a lookup join) is added only for the queries that read it."""
    return events_from_tables(spark, sf_dir, blank_user="keep", with_location=location)


def ev_null(spark: SparkSession, sf_dir: str, location: bool = False) -> DataFrame:
    """Exploration view: the blank user id is null."""
    return events_from_tables(spark, sf_dir, blank_user="null", with_location=location)


# --- sources / scalars ------------------------------------------------------
_LOGS: dict[tuple[str, str], str] = {}


def _event_log(s: SparkSession, d: str) -> str:
    """The tables' events as a JSON-Lines log on shared storage, written once per application."""
    key = (s.sparkContext.applicationId, d)
    if key not in _LOGS:
        path = f"{checkpoint_dir(s).rstrip('/')}/event-log-{uuid.uuid4().hex}"
        write_event_log(ev_keep(s, d, location=True), path)
        _LOGS[key] = path
    return _LOGS[key]


@register("load_events")
def _load(s, d):
    """The log read back by the loader; ``event_seq`` as the place in log order."""
    ev = canonical(load_events(s, _event_log(s, d)))
    ranked = global_rank(ev, F.shiftright("event_seq", 20), [F.col("event_seq")])
    return ranked.withColumn("event_seq", F.col("grank").cast("long")).drop("grank")


register("events_profile")(lambda s, d: X.events_profile(ev_keep(s, d)))
register("enrich_calendar")(lambda s, d: X.enrich_calendar(ev_null(s, d)))
register("days_since_registration")(lambda s, d: X.days_since_registration(ev_null(s, d)))
register("parse_user_agent")(lambda s, d: X.parse_user_agent(ev_null(s, d)))
register("normalize_blank")(lambda s, d: ev_null(s, d).select("event_seq", "userId"))
register("filter_pages")(lambda s, d: canonical(X.filter_pages(ev_keep(s, d, location=True))))

# --- exploration ------------------------------------------------------------
register("total_unique_users")(lambda s, d: X.total_unique_users(ev_null(s, d)))
register("active_users_per_day")(lambda s, d: X.active_users_per_day(ev_null(s, d)))
register("sessions_per_day")(lambda s, d: X.sessions_per_day(ev_null(s, d)))
register("series_pair_join")(lambda s, d: X.users_and_sessions_per_day(ev_null(s, d)))
register("sessions_by_hour")(lambda s, d: X.sessions_by_hour(ev_null(s, d)))
register("session_durations")(lambda s, d: X.session_durations(ev_null(s, d)))
register("session_duration_join")(lambda s, d: X.session_duration_join(ev_null(s, d, location=True)))
register("events_by_gender")(lambda s, d: X.events_by_gender(ev_null(s, d)))
register("users_by_gender")(lambda s, d: X.users_by_gender(ev_null(s, d)))
register("page_counts")(lambda s, d: X.page_counts(ev_null(s, d)))
register("page_by_level")(lambda s, d: X.page_by_level(ev_null(s, d)))
register("page_by_level_pct")(lambda s, d: X.page_by_level_pct(ev_null(s, d)))
register("sessions_per_user")(lambda s, d: X.sessions_per_user(ev_null(s, d)))
register("devices_per_user")(lambda s, d: X.devices_per_user(ev_null(s, d)))
register("avg_session_hours_per_user")(lambda s, d: X.avg_session_hours_per_user(ev_null(s, d)))
register("top_locations")(lambda s, d: X.top_locations(ev_null(s, d, location=True)))
register("top_users")(lambda s, d: C.top_users(ev_null(s, d)))

# --- churn ------------------------------------------------------------------
register("level_neighbours")(lambda s, d: C.level_neighbours(ev_keep(s, d)))
register("churn_events")(lambda s, d: C.churn_events(ev_keep(s, d, location=True)))
register("churn_timestamps")(lambda s, d: C.churn_timestamps(ev_keep(s, d)))
register("churn_summary")(lambda s, d: C.churn_summary(ev_null(s, d)))
register("assert_churn_meaning")(lambda s, d: C.assert_churn_meaning(ev_null(s, d)))


@register("flag_churned_users")
def _flag(s, d):
    ev = ev_null(s, d)
    return C.flag_churned_users(ev, C.churn_timestamps(ev)).select("event_seq", "userId", "is_churned_user")


register("time_to_churn")(lambda s, d: C.time_to_churn(ev_null(s, d)))
register("time_to_churn_stats")(lambda s, d: C.time_to_churn_stats(C.time_to_churn(ev_null(s, d))))
register("resubscribe")(lambda s, d: C.resubscribe(ev_null(s, d)))
register("resubscribe_summary")(lambda s, d: C.resubscribe_summary(C.resubscribe(ev_null(s, d))))


def _with_churn(fn):
    def run(s, d):
        ev = ev_null(s, d)
        return fn(ev, C.churn_timestamps(ev))

    return run


register("daily_churn_rate")(_with_churn(C.daily_churn_rate))
register("daily_churn_rate_churn_days")(_with_churn(lambda ev, ct: C.daily_churn_rate(ev, ct, churn_days_only=True)))
register("churn_rate_by_dom")(_with_churn(C.churn_rate_by_dom))
register("churn_rate_by_dow")(_with_churn(C.churn_rate_by_dow))
register("churn_by_gender")(_with_churn(C.churn_by_gender))
register("churn_context")(lambda s, d: C.churn_context(ev_null(s, d, location=True), n_events=3, radius=5))
register("session_timeline")(lambda s, d: C.session_timeline(ev_null(s, d)))


def queries() -> dict[str, Query]:
    # import side effects register the remaining groups
    from attrition.plans import catalog_features, catalog_model, catalog_train  # noqa: F401

    return dict(REGISTRY)
