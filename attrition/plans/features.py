"""The user-day feature table (48 model inputs + label) as one lazy plan.

Two spine policies share the same code:

* ``train``: each user's spine runs from the first active day to the first
  churn day, or the last active day if the user never churned. Static
  values are per user: registration = earliest registration of the user,
  gender = the user's first event by time.
* ``asof``: for scoring. Each requested user's spine runs from the first
  active day to the latest requested cutoff day (past the last activity if
  need be) and ignores churn. The values of a row only use events up to
  that row's day: registration is a running minimum, gender the first event
  in log order among events up to the day. A request at any time of day d
  sees all of day d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.config import CORE_COLUMNS, LABEL, Params, feature_names
from attrition.functions.expr import cyclical, day_of_week, safe_div
from attrition.functions.sequence import key_tag
from attrition.operators.churn import churn_timestamps
from attrition.operators.daily import daily_aggregates_with_dims, densify, window_sums
from attrition.sources.user_days import BUCKETS, bucket_of, read_user_days


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def daily_table(ev: DataFrame) -> DataFrame:
    """Active user-days with the 13 core counts, the day's artist entropy and
    per-day dimension pieces."""
    return daily_aggregates_with_dims(ev)


def dense_daily(
    ev: DataFrame | None, policy: str = "train", ends: DataFrame | None = None, churn_ts: DataFrame | None = None, days: DataFrame | None = None
) -> DataFrame:
    """Dense user-day rows with core counts, entropy, churn and static dims.

    ``ends`` (policy ``asof``): ``userId, end_date``. ``days``: the user-days, if they
    needn't be made from ``ev``. User-level values are
    window aggregates over the user's active days (already partitioned by
    user for the gap filling), not a separate aggregate + join."""
    days = daily_table(ev) if days is None else days
    fill = CORE_COLUMNS + ["artist_entropy_day"]
    user = Window.partitionBy("userId")
    if policy == "train":
        churn_ts = churn_timestamps(ev) if churn_ts is None else churn_ts
        x = days.join(churn_ts.select("userId", "churn_ts", "churn_date"), "userId", "left")
        last_date = F.max("date").over(user)
        x = x.withColumns(
            {
                "_reg": F.min("_reg_day").over(user),
                "_gcode": key_tag(F.min("_first_by_time").over(user)) - F.lit(1),
                "_end": F.coalesce(F.least(F.col("churn_date"), last_date), last_date),
            }
        )
        dense = densify(x, "_end", fill, {"artist_entropy_day": F.lit(0.0)})
        return dense.drop("_end", "_reg_day", "_first_by_time", "_first_by_seq")
    if policy == "asof":
        x = days.join(ends.select("userId", F.col("end_date").alias("_end")), "userId", "inner")
        dense = densify(x, "_end", fill, {"artist_entropy_day": F.lit(0.0)}).drop("_end")
        run = Window.partitionBy("userId").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return dense.withColumns(
            {
                # values of events up to the row's day only
                "_reg": F.min("_reg_day").over(run),
                "_gcode": key_tag(F.min("_first_by_seq").over(run)) - F.lit(1),
                "churn_ts": F.lit(None).cast("timestamp_ntz"),
                "churn_date": F.lit(None).cast("date"),
            }
        ).drop("_reg_day", "_first_by_time", "_first_by_seq")
    raise ValueError("policy must be 'train' or 'asof'")


def derive_features(dense: DataFrame, params: Params = Params()) -> DataFrame:
    """All 79 columns on top of the dense daily rows; keeps the row keys,
    ``churn_date`` and the label."""
    s, l, h = params.recent_window, params.long_window, params.horizon_days
    x = window_sums(dense, CORE_COLUMNS, s, l)
    dow, dom = day_of_week("date"), F.dayofmonth("date")
    dow_sin, dow_cos = cyclical(dow, 7)
    dom_sin, dom_cos = cyclical(dom, 31)

    def ratio(num: str, den: str) -> Column:
        return safe_div(_c(num), _c(den))

    # calendar, static and ratio columns in one projection
    x = x.withColumns(
        {
            "day_of_month": dom,
            "day_of_week": dow,
            "days_since_join": F.coalesce(F.datediff(F.col("date"), F.to_date("_reg")), F.lit(0)),
            "gender_code": F.col("_gcode"),
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "dom_sin": dom_sin,
            "dom_cos": dom_cos,
            "ratio_thumbs_up": ratio("cum_Thumbs Up", "cum_NextSong"),
            "ratio_playlist": ratio("cum_Add to Playlist", "cum_NextSong"),
            "ratio_friend": ratio("cum_Add Friend", "cum_NextSong"),
            f"ratio{s}_thumbs_up": ratio(f"win{s}_Thumbs Up", f"win{s}_NextSong"),
            f"ratio{s}_playlist": ratio(f"win{s}_Add to Playlist", f"win{s}_NextSong"),
            f"ratio{s}_friend": ratio(f"win{s}_Add Friend", f"win{s}_NextSong"),
            f"ratio{l}_thumbs_up": ratio(f"win{l}_Thumbs Up", f"win{l}_NextSong"),
            f"ratio{l}_playlist": ratio(f"win{l}_Add to Playlist", f"win{l}_NextSong"),
            f"ratio{l}_friend": ratio(f"win{l}_Add Friend", f"win{l}_NextSong"),
            f"win{s}_error_rate": ratio(f"win{s}_Error", f"win{s}_events"),
            f"win{s}_help_rate": ratio(f"win{s}_Help", f"win{s}_events"),
            "downgrade_wo_submit": ((_c("cum_Downgrade") > 0) & (_c("cum_Submit Downgrade") == 0)).cast("int"),
            "prop_nextsong": ratio("cum_NextSong", "cum_events"),
        }
    )
    cd, d = F.col("churn_date"), F.col("date")
    x = x.withColumns(
        {
            "chg_thumbs_up": _c(f"ratio{s}_thumbs_up") - _c("ratio_thumbs_up"),
            "chg_playlist": _c(f"ratio{s}_playlist") - _c("ratio_playlist"),
            "chg_friend": _c(f"ratio{s}_friend") - _c("ratio_friend"),
            f"delta{s}_{l}_thumbs": _c(f"ratio{s}_thumbs_up") - _c(f"ratio{l}_thumbs_up"),
            f"delta{s}_{l}_playlist": _c(f"ratio{s}_playlist") - _c(f"ratio{l}_playlist"),
            LABEL: (cd.isNotNull() & (cd > d) & (cd <= F.date_add(d, h))).cast("int"),
        }
    )
    return x.filter(cd.isNull() | (d <= cd))


def feature_matrix(feat: DataFrame, params: Params = Params(), keys: bool = True) -> DataFrame:
    """The model matrix: ordered feature columns as finite doubles (+-Inf,
    NaN and null -> 0) and the label."""
    names = feature_names(params)
    key_cols = ["userId", "date"] if keys else []
    return feat.selectExpr(*key_cols, *[finite_or_zero_sql(n) for n in names], f"CAST({LABEL} AS BIGINT) AS {LABEL}")


def finite_or_zero_sql(name: str) -> str:
    x = f"CAST(`{name}` AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('inf') THEN 0.0D ELSE {x} END AS `{name}`"


def user_day_features(ev: DataFrame, params: Params = Params(), churn_ts: DataFrame | None = None) -> DataFrame:
    """Training table: ``userId, date, <48 features>, label_churn_horizon``."""
    return feature_matrix(derive_features(dense_daily(ev, "train", churn_ts=churn_ts), params), params)


def asof_features(ev: DataFrame, requests: DataFrame, params: Params = Params()) -> DataFrame:
    """Feature row of each request ``(user_id, date)`` as of the end of the
    request's day, for all requests at once.

    Only events of requested users up to their last requested day are
    aggregated. Returns
    ``user_id, date, status, <48 features>``; ``status`` is ``ok``,
    ``unknown_user`` or ``no_activity`` (no event on or before the day), with
    null features for the last two."""
    req, ends = _asked(requests)
    asked = ev.join(ends, "userId")
    # later events can't be seen by any request: they go before anything is aggregated
    evr = asked.filter(F.col("date") <= F.col("end_date")).drop("end_date")
    return _answer(req, dense_daily(evr, "asof", ends=ends), asked, params)


def asof_features_stored(spark: SparkSession, folder: str, requests: DataFrame, params: Params = Params(), buckets: int = BUCKETS) -> DataFrame:
    """``asof_features`` from the user-days in ``folder`` (``sources.user_days``): reads
    the asked users' buckets, their features up to the last asked day, and no events.

    The driver learns the buckets that are asked for (at most ``buckets`` numbers) and
    the last day; they become partition filters of the scan."""
    req, ends = _asked(requests)
    wanted = ends.agg(F.collect_set(bucket_of("userId", buckets)).alias("b"), F.max("end_date").alias("last")).first()
    stored = read_user_days(spark, folder, buckets).filter(F.col("bucket").isin(wanted["b"])).drop("bucket")
    seen = stored.filter(F.col("date") <= F.lit(wanted["last"]).cast("date")).join(ends, "userId")
    seen = seen.filter(F.col("date") <= F.col("end_date")).drop("end_date")
    return _answer(req, dense_daily(None, "asof", ends=ends, days=seen), stored, params)


def _asked(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests with their day, and each user's last asked day."""
    day = F.col("date").cast("timestamp_ntz")
    req = requests.select(F.col("user_id"), day.alias("date"), F.to_date(day).alias("_day"))
    return req, req.groupBy(F.col("user_id").alias("userId")).agg(F.max("_day").alias("end_date"))


def _answer(req: DataFrame, dense: DataFrame, known: DataFrame, params: Params) -> DataFrame:
    """A row for each request from the dense user-days; users in ``known`` occur in the log."""
    feat = feature_matrix(derive_features(dense, params), params)
    feat = feat.withColumnRenamed("userId", "_u").withColumnRenamed("date", "_day").drop(LABEL)
    known = known.select(F.col("userId").alias("_k")).distinct()
    out = req.join(feat, (req["user_id"] == feat["_u"]) & (req["_day"] == feat["_day"]), "left").drop(feat["_day"])
    out = out.join(known, out["user_id"] == known["_k"], "left")
    status = (
        F.when(F.col("_k").isNull(), F.lit("unknown_user"))
        .when(F.col("_u").isNull(), F.lit("no_activity"))
        .otherwise(F.lit("ok"))
    )
    names = feature_names(params)
    return out.select("user_id", "date", status.alias("status"), *[_c(n) for n in names])
