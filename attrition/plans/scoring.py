"""Batch scoring of ``(user_id, date)`` requests with a saved model bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.sources.user_days import BUCKETS


def reindex_columns(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Project onto ``columns`` in that order; a column ``df`` lacks is
    filled with ``fill``."""
    have = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in have else F.lit(fill).cast("double").alias(c) for c in columns]
    )


def requests_from_events(ev: DataFrame) -> DataFrame:
    """Scoring requests derived from the log (``user_id, date``), three per
    user: the middle day of the user's active span at 12:00; the day before
    the first activity; and that middle day for a user id that doesn't occur."""
    b = ev.filter(F.col("userId").isNotNull() & F.col("date").isNotNull()).groupBy("userId").agg(
        F.min("date").alias("_f"), F.max("date").alias("_l")
    )
    noon = lambda d: d.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    mid = F.date_add(F.col("_f"), F.floor(F.datediff("_l", "_f") / 2).cast("int"))
    ask = lambda who, day: F.struct(who.alias("user_id"), noon(day).alias("date"))
    asked = F.array(
        ask(F.col("userId"), mid),
        ask(F.col("userId"), F.date_sub("_f", 1)),
        ask(F.concat(F.lit("no such user "), "userId"), mid),
    )
    return b.select(F.inline(asked))


def filter_user_asof(ev: DataFrame, requests: DataFrame) -> DataFrame:
    """The events each request ``(user_id, date)`` may see: those of the user
    up to the end of the request's day. Columns ``user_id, date, status,
    event_seq, datetime``; a request without such an event has one row with
    status ``unknown_user`` or ``no_activity`` and null event columns."""
    req = requests.select("user_id", F.col("date").cast("timestamp_ntz").alias("date")).distinct()
    e = ev.filter(F.col("userId").isNotNull()).select("userId", "event_seq", "datetime", F.col("date").alias("_day"))
    seen = req.join(e.filter(F.col("_day").isNotNull()), (F.col("user_id") == F.col("userId")) & (F.col("_day") <= F.to_date("date")), "left")
    known = e.select(F.col("userId").alias("_known")).distinct()
    missing = seen.filter(F.col("userId").isNull()).join(known, F.col("user_id") == F.col("_known"), "left")
    missing = missing.select("user_id", "date", F.when(F.col("_known").isNull(), "unknown_user").otherwise("no_activity").alias("status"), "event_seq", "datetime")
    found = seen.filter(F.col("userId").isNotNull()).select("user_id", "date", F.lit("ok").alias("status"), "event_seq", "datetime")
    return found.unionByName(missing)


def score_requests(ev: DataFrame, requests: DataFrame, bundle, params=None) -> DataFrame:
    """Score many ``(user_id, date)`` requests at once: as-of features of the
    end of the request day, aligned to the bundle's feature order (missing
    columns 0), P(churn) from the model and ``label = probability >=
    threshold``. Requests for unknown users or days before any activity get
    a ``status`` and null probability instead of an error."""
    from attrition.config import Params
    from attrition.plans.features import asof_features

    return score_features(asof_features(ev, requests, params or Params()), bundle)


def score_requests_stored(spark: SparkSession, folder: str, requests: DataFrame, bundle, params=None, buckets: int = BUCKETS) -> DataFrame:
    """``score_requests`` from stored user-days (``asof_features_stored``)."""
    from attrition.config import Params
    from attrition.plans.features import asof_features_stored

    return score_features(asof_features_stored(spark, folder, requests, params or Params(), buckets), bundle)


def score_features(feat: DataFrame, bundle) -> DataFrame:
    """The scores of as-of features ``user_id, date, status, ...``."""
    from attrition.plans.boost import predict_proba

    x = reindex_columns(feat, ["user_id", "date", "status"] + bundle.features, fill=0.0)
    x = x.fillna(0.0, subset=bundle.features)
    ok = F.col("status") == "ok"
    scored = predict_proba(bundle.model, x)
    p = F.when(ok, F.col("probability"))
    return scored.select(
        "user_id",
        "date",
        p.alias("probability"),
        F.when(ok, (F.col("probability") >= F.lit(bundle.threshold)).cast("int")).alias("label"),
        F.lit(float(bundle.threshold)).alias("threshold"),
        "status",
    )
