"""Twin test (as-of lookup equals the training row), feature-table
invariants, and a property test of the skew-safe sequence numbering."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import Window

from attrition.config import FEATURES, LABEL
from attrition.functions.sequence import global_rank, sequence_view
from attrition.plans.features import asof_features, user_day_features
from attrition.sources.events import events_from_tables
from tests.conftest import SF_SMALL


def test_asof_equals_training_row(spark):
    ev = events_from_tables(spark, SF_SMALL, "keep")
    train = user_day_features(ev)
    req = train.select(F.col("userId").alias("user_id"), (F.col("date").cast("timestamp_ntz")).alias("date"))
    asof = asof_features(ev, req)
    a = asof.withColumn("date", F.to_date("date")).withColumnRenamed("user_id", "userId")
    cols = ["userId", "date"] + [f"`{c}`" for c in FEATURES]
    rounded = lambda df: df.select("userId", "date", *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in FEATURES])
    diff = rounded(train.select(*cols)).exceptAll(rounded(a.select(*cols)))
    assert asof.filter(F.col("status") != "ok").count() == 0
    assert diff.count() == 0


def test_feature_table_invariants(spark):
    ev = events_from_tables(spark, SF_SMALL, "keep")
    t = user_day_features(ev)
    assert t.count() == t.select("userId", "date").distinct().count()
    per_user = t.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    assert per_user.filter(F.col("n") != F.datediff("b", "a") + 1).count() == 0  # no gaps
    w = Window.partitionBy("userId").orderBy("date")
    bad = t.withColumn("_prev", F.lag("cum_events").over(w)).filter(
        (F.col("_prev") > F.col("cum_events"))
        | (F.col("win7_events") > F.col("win14_events"))
        | (F.col("win14_events") > F.col("cum_events"))
    )
    assert bad.count() == 0
    # labels only before the churn day
    from attrition.operators.churn import churn_timestamps

    lab = t.join(churn_timestamps(ev), "userId", "left").filter(F.col(LABEL) == 1)
    assert lab.filter(F.col("churn_date").isNull() | (F.col("date") >= F.col("churn_date"))).count() == 0


events_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", ""]), st.integers(0, 72), st.sampled_from(["paid", "free"])),
    min_size=1,
    max_size=40,
)


@settings(max_examples=15, deadline=None)
@given(events_strategy)
def test_sequence_view_matches_plain_window(spark, evs):
    base = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame(
        [(i, u, base + pd.Timedelta(hours=h), lv) for i, (u, h, lv) in enumerate(evs)],
        columns=["event_seq", "userId", "datetime", "level"],
    )
    df = spark.createDataFrame(pdf, "event_seq long, userId string, datetime timestamp_ntz, level string")
    got = sequence_view(df, "userId", ("level",)).select("event_seq", "rn", "n_part", "prev_level", "next_level")
    w = Window.partitionBy("userId").orderBy("datetime", "event_seq")
    want = df.select(
        "event_seq",
        F.row_number().over(w).cast("long").alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("userId")).alias("n_part"),
        F.lag("level").over(w).alias("prev_level"),
        F.lead("level").over(w).alias("next_level"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 997).cast("double").alias("s"), F.col("id"))
    got = global_rank(df, F.floor(F.col("s") / 50), [F.col("s"), F.col("id")]).select("id", "grank")
    want = df.select("id", F.row_number().over(Window.orderBy("s", "id")).cast("long").alias("grank"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
