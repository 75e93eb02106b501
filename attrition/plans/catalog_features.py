"""Feature-table queries of the catalog (user-day grain)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import CORE_COLUMNS, LABEL, PAGES, Params
from attrition.functions.expr import gender_code, safe_div
from attrition.operators import daily as D
from attrition.operators.churn import first_row_values
from attrition.plans.catalog import ev_keep, register
from attrition.plans.features import dense_daily, derive_features, feature_matrix

P = Params()
S, L = P.recent_window, P.long_window
KEYS = ["userId", "date"]


def _q(c: str):
    return F.col(f"`{c}`")


def _train_dense(s, d) -> DataFrame:
    return dense_daily(ev_keep(s, d), "train")


def _train_feat(s, d) -> DataFrame:
    return derive_features(_train_dense(s, d), P)


register("daily_events")(lambda s, d: D.daily_aggregates(ev_keep(s, d)).select(*KEYS, "events"))
register("daily_listen")(lambda s, d: D.daily_aggregates(ev_keep(s, d)).select(*KEYS, "listen_sec"))
register("daily_pages")(lambda s, d: D.daily_aggregates(ev_keep(s, d)).select(*KEYS, *[_q(p) for p in PAGES]))
register("daily_assemble")(lambda s, d: D.daily_aggregates(ev_keep(s, d)))
register("user_activity_bounds")(lambda s, d: D.user_activity_bounds(ev_keep(s, d)))
register("artist_entropy")(lambda s, d: D.artist_entropy(ev_keep(s, d)))
register("share_of_day")(lambda s, d: D.share_of_day(ev_keep(s, d)))
register("daily_spine")(lambda s, d: _train_dense(s, d).select(*KEYS, *[_q(c) for c in CORE_COLUMNS]))
register("attach_entropy")(lambda s, d: _train_dense(s, d).select(*KEYS, "artist_entropy_day"))


@register("attach_user_dims")
def _dims(s, d):
    x = _train_dense(s, d)
    return x.select(*KEYS, "churn_ts", "churn_date", F.col("_reg").alias("registration_datetime"),
                    F.col("_gcode").cast("long").alias("gender_code"))


register("gender_code")(lambda s, d: first_row_values(ev_keep(s, d), ["gender"]).select(
    "userId", gender_code("gender").cast("long").alias("gender_code")))


@register("safe_div")
def _safe_div(s, d):
    x = D.daily_aggregates(ev_keep(s, d))
    return x.select(*KEYS, safe_div(_q("Thumbs Up"), _q("NextSong")).alias("thumbs_up_per_song"))


def _sel(cols):
    def run(s, d):
        x = _train_feat(s, d)
        return x.select(*KEYS, *[_q(c).cast("double").alias(c) for c in cols])

    return run


register("cumulative_features")(_sel([f"cum_{c}" for c in CORE_COLUMNS]))
register("rolling_features")(_sel([f"win{S}_{c}" for c in CORE_COLUMNS] + [f"win{L}_{c}" for c in CORE_COLUMNS]))
register("days_since_join")(_sel(["days_since_join"]))
register("cyclical_encode")(_sel(["day_of_week", "day_of_month", "dow_sin", "dow_cos", "dom_sin", "dom_cos"]))
register("ratio_features")(_sel(["ratio_thumbs_up", "ratio_playlist", "ratio_friend",
                                 f"ratio{S}_thumbs_up", f"ratio{S}_playlist", f"ratio{S}_friend",
                                 f"ratio{L}_thumbs_up", f"ratio{L}_playlist", f"ratio{L}_friend"]))
register("change_features")(_sel(["chg_thumbs_up", "chg_playlist", "chg_friend",
                                  f"delta{S}_{L}_thumbs", f"delta{S}_{L}_playlist"]))
register("intensity_features")(_sel([f"win{S}_error_rate", f"win{S}_help_rate"]))
register("downgrade_wo_submit")(_sel(["downgrade_wo_submit"]))
register("prop_nextsong")(_sel(["prop_nextsong"]))


@register("label_horizon")
def _label(s, d):
    x = _train_feat(s, d)
    return x.select(*KEYS, "churn_date", F.col(LABEL).cast("long").alias(LABEL))


register("user_day_features")(lambda s, d: feature_matrix(_train_feat(s, d), P))
register("clean_matrix")(lambda s, d: feature_matrix(_train_feat(s, d), P, keys=False))


@register("reindex_columns")
def _reindex(s, d):
    """The dense daily table projected onto a requested column list; a
    requested column the table lacks is filled with 0."""
    from attrition.plans.scoring import reindex_columns

    x = _train_dense(s, d)
    wanted = ["events", "NextSong", "Thumbs Up", "Submit Upgrade", "listen_sec"]
    return reindex_columns(x, KEYS + wanted)


@register("class_balance")
def _balance(s, d):
    from attrition.operators.evaluate import class_balance

    return class_balance(feature_matrix(_train_feat(s, d), P), LABEL)


# --- user table, correlations, histograms -----------------------------------
from attrition.operators import churn as C  # noqa: E402
from attrition.operators import explore as X  # noqa: E402
from attrition.operators import users as U  # noqa: E402
from attrition.operators.histogram import histogram  # noqa: E402
from attrition.plans.catalog import ev_null  # noqa: E402


def _user_table(s, d):
    return U.user_features(ev_null(s, d))


register("user_features")(_user_table)
register("position_thirds")(lambda s, d: U.position_thirds(ev_null(s, d).filter(F.col("userId").isNotNull())))
register("position_halves")(lambda s, d: U.position_halves(ev_null(s, d).filter(F.col("userId").isNotNull())))
register("first_row_per_user")(lambda s, d: C.first_row_values(ev_null(s, d), ["gender", "registration_datetime"]))
register("correlation_with_churn")(lambda s, d: U.correlation_with(_user_table(s, d)))
register("correlation_matrix")(lambda s, d: U.correlation_matrix(_user_table(s, d)))
register("top_abs_correlations")(lambda s, d: U.top_abs_correlations(U.correlation_with(_user_table(s, d))))


@register("missing_users_check")
def _missing(s, d):
    """Base users with no churn time (the series that does not cover every
    user), by anti-join."""
    ev = ev_null(s, d)
    base = ev.filter(F.col("userId").isNotNull()).select("userId").distinct()
    return U.missing_users(base, C.churn_timestamps(ev))


@register("align_to_users")
def _align(s, d):
    """A partial per-user series (time to churn) aligned to the full sorted
    user list: null where the series has no value."""
    ev = ev_null(s, d)
    base = ev.filter(F.col("userId").isNotNull()).select("userId").distinct()
    return base.join(C.time_to_churn(ev), "userId", "left")


@register("assert_user_table")
def _assert_users(s, d):
    ev = ev_null(s, d)
    return U.assert_user_table(_user_table(s, d), ev.filter(F.col("userId").isNotNull()))


def _hist(values, column, n, weight=None):
    def run(s, d):
        return histogram(values(ev_null(s, d)), column, n, weight)

    return run


register("histogram_session_length")(_hist(X.session_sizes, "session_duration_min", 50, "events"))
register("histogram_sessions_per_user")(_hist(X.sessions_per_user, "sessions", 50))
register("histogram_devices_per_user")(_hist(X.devices_per_user, "devices", 20))
register("histogram_avg_session_hours")(_hist(X.avg_session_hours_per_user, "avg_session_hours", 10))
register("histogram_time_to_churn")(_hist(C.time_to_churn, "time_to_churn_days", 30))
