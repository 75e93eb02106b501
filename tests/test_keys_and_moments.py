"""Hash-aggregate-friendly encodings and the one-pass correlation merge."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from attrition.functions.sequence import key_tag, tagged_order_key, tagged_seq_key
from attrition.operators import users as U
from attrition.sources.events import load_events
from tests.conftest import BASE_MS, DAY, HOUR, event


def test_tagged_order_key_orders_like_time_then_sequence(spark):
    t = dt.datetime
    data = [
        (t(2024, 1, 1), 3, 0),
        (t(2024, 1, 1), 9_223_372_036_854_775_807, 2),  # largest sequence number
        (t(1960, 5, 1, 12), 5, 1),  # before the epoch
        (None, 0, 2),  # null times sort last
        (None, 1, 0),
        (t(9999, 12, 31, 23, 59, 59), 7, 1),
        (t(2024, 1, 1, 0, 0, 0, 1), 0, 0),  # one microsecond later
        (t(2024, 1, 1), -9_223_372_036_854_775_808, 3),  # hashed sequence numbers may be negative
        (t(2024, 1, 1, 0, 0, 0, 1), -1, 1),
    ]
    df = spark.createDataFrame(data, "datetime timestamp_ntz, event_seq long, tag int")
    got = df.select(
        "datetime", "event_seq", "tag",
        tagged_order_key(F.col("tag")).alias("k"), tagged_seq_key(F.col("tag")).alias("ks"),
    )
    got = got.withColumn("kt", key_tag("k")).withColumn("kst", key_tag("ks")).collect()
    by_key = [(r["datetime"], r["event_seq"]) for r in sorted(got, key=lambda r: r["k"])]
    expected = sorted(((d, s) for d, s, _ in data), key=lambda x: (x[0] is None, x[0] or t.min, x[1]))
    assert by_key == expected
    assert all(r["kt"] == r["tag"] and r["kst"] == r["tag"] for r in got)
    assert [r["event_seq"] for r in sorted(got, key=lambda r: r["ks"])] == sorted(s for _, s, _ in data)


def test_first_event_gender_uses_time_then_log_order(spark, jsonl):
    # two events at the same instant: the earlier line wins; a later-timed
    # line that comes first in the file does not
    path = jsonl([
        event("1", BASE_MS + HOUR, gender="F"),
        event("1", BASE_MS, gender="M"),
        event("1", BASE_MS, gender="F"),
        event("2", BASE_MS, gender=None),
        event("2", BASE_MS + DAY, gender="F"),
    ])
    ut = U.user_features(load_events(spark, path, "null"))
    got = {r["userId"]: r["gender_code"] for r in ut.collect()}
    assert got == {"1": 1.0, "2": -1.0}


def test_most_common_day_ties_go_to_the_lowest_weekday(spark, jsonl):
    # 2024-01-01 is a Monday (0); Tuesday (1) and Wednesday (2) twice each
    path = jsonl([
        event("1", BASE_MS + DAY), event("1", BASE_MS + DAY + HOUR),
        event("1", BASE_MS + 2 * DAY), event("1", BASE_MS + 2 * DAY + HOUR),
        event("1", BASE_MS),
        event("2", BASE_MS + 6 * DAY),
    ])
    ut = U.user_features(load_events(spark, path, "null"))
    got = {r["userId"]: r["most_common_day"] for r in ut.collect()}
    assert got == {"1": 1.0, "2": 6.0}


def test_correlation_matrix_merges_partitions_and_nulls_constant_columns(spark):
    rng = np.random.default_rng(7)
    n = 400
    a = rng.normal(50.0, 3.0, n)
    b = 2.0 * a + rng.normal(0.0, 1.0, n)
    c = np.full(n, 0.1)  # constant: correlation undefined
    d = rng.normal(1e6, 1.0, n)  # large offset, small spread
    b[rng.choice(n, 40, replace=False)] = np.nan
    d[rng.choice(n, 25, replace=False)] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    sdf = spark.createDataFrame(pdf).repartition(5)  # several partitions to merge
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in U.correlation_matrix(sdf, list(pdf)).collect()}
    ref = pdf.corr()  # pairwise-complete Pearson, NaN for zero variance
    assert len(got) == 16
    for (x, y), v in got.items():
        want = ref.loc[x, y]
        if math.isnan(want):
            assert v is None, (x, y, v)
        else:
            assert v is not None and abs(v - want) < 1e-9, (x, y, v, want)


def test_sequence_view_same_result_for_any_buckets(spark):
    from attrition.functions.sequence import sequence_view
    from attrition.sources.events import events_from_tables
    from tests.conftest import SF_SMALL

    ev = events_from_tables(spark, SF_SMALL, "keep")
    cols = ["event_seq", "rn", "n_part", "prev_level", "next_level", "prev_date", "next_date", "len_rn", "len_total"]
    day, hour = F.unix_date("date").cast("long"), F.hour("datetime").cast("long")

    def view(bucket):
        v = sequence_view(ev, "userId", ("level", "date"), counters={"len": F.col("length").isNotNull()}, bucket=bucket)
        return sorted(tuple(r) for r in v.select(*cols).collect())

    usual, coarse, single = view(None), view(day * 2 + F.floor(hour / 12)), view(F.lit(1).cast("long"))
    assert len(usual) == ev.filter(F.col("userId").isNotNull()).count()
    assert usual == coarse == single


def test_a_user_with_half_the_log_and_many_null_times_is_ordered(spark):
    from attrition.functions.sequence import sequence_view

    n = 4000
    ev = spark.range(n).select(
        (F.col("id") * 5000 - 3 * 10**6).alias("event_seq"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("userId"),
        F.when(F.col("id") % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919 % 20000).cast("decimal(18,6)"))
        ).alias("datetime"),
        (F.col("id") % 7).alias("v"),
    )
    got = sequence_view(ev, "userId", ("v",)).where("userId = 'hot'").orderBy("rn").collect()
    want = sorted((r for r in ev.where("userId = 'hot'").collect()), key=lambda r: (r.datetime is None, r.datetime or dt.datetime.min, r.event_seq))
    assert [r.rn for r in got] == list(range(1, n // 2 + 1)) and {r.n_part for r in got} == {n // 2}
    assert [(r.event_seq, r.v) for r in got] == [(r.event_seq, r.v) for r in want]
    assert [r.prev_v for r in got] == [None] + [r.v for r in want][:-1]
    assert [r.next_v for r in got] == [r.v for r in want][1:] + [None]


def test_an_event_is_shuffled_once(spark):
    """A user with an event in every second: at most 1.3 records shuffled for an event."""
    from attrition.functions.sequence import sequence_view

    n = 40_000
    ev = spark.range(n).select(
        F.col("id").alias("event_seq"), (F.col("id") % 1).cast("string").alias("userId"), (F.col("id") % 2).alias("level_code"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("datetime"),
    )
    frame = sequence_view(ev, "userId", ("level_code",))
    frame.collect()
    written, stack = [], [frame._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name, children = node.nodeName(), node.children()
        if name == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(node.plan())
        stack += [children.apply(i) for i in range(children.size())]
    assert n <= sum(written) <= 1.3 * n, written


def test_churn_reads_the_log_once(spark):
    from attrition.operators.churn import churn_timestamps
    from attrition.sources.events import events_from_tables
    from tests.conftest import SF_SMALL

    frame = churn_timestamps(events_from_tables(spark, SF_SMALL, "keep", with_location=False))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_a_partnerless_outlier_does_not_hide_a_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.0, 1.0, 500)
    y = 2 * x + rng.normal(0.0, 1.0, 500)
    rows = [(1e9, None)] + [(float(a), float(b)) for a, b in zip(x, y)]
    table = spark.createDataFrame(rows, "x double, y double").coalesce(1)
    matrix = {(r.feature_a, r.feature_b): r["corr"] for r in U.correlation_matrix(table, ["x", "y"]).collect()}
    single = {r.feature: r["corr"] for r in U.correlation_with(table, "y", ["x"]).collect()}
    assert abs(matrix["x", "y"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert abs(matrix["x", "y"] - single["x"]) < 1e-9 and matrix["x", "y"] == matrix["y", "x"]


def test_second_buckets_keep_ties_and_null_times_in_order(spark, jsonl):
    from attrition.functions.sequence import sequence_view

    t0 = BASE_MS + 5 * HOUR - 1000  # one second before an hour boundary
    lines = [
        event("1", t0 + 1500, level="free"),
        event("1", t0, level="paid"),
        event("1", t0, level="free"),  # same instant: file order decides
        event("1", t0 + 200, level="paid"),  # same second
        event("1", None, level="free"),  # null time: last
        event("1", t0 + 1000, level="paid"),  # exactly on the hour
        event("2", t0, level="paid"),
    ]
    ev = load_events(spark, jsonl(lines))
    cols = ["event_seq", "rn", "n_part", "prev_level", "next_level"]
    got = [sorted(tuple(r) for r in sequence_view(ev, "userId", ("level",)).select(*cols).collect())]
    # expected: user 1 by (time nulls last, file position)
    u1 = sorted(
        [(r["ts"], i, r["level"]) for i, r in enumerate(lines) if r["userId"] == "1"],
        key=lambda x: (x[0] is None, x[0] or 0, x[1]),
    )
    seqs = {r["event_seq"]: r for r in ev.select("event_seq", "userId", "datetime").collect()}
    by_rn = [row for row in got[0] if seqs[row[0]]["userId"] == "1"]
    by_rn.sort(key=lambda r: r[1])
    levels = [lv for _, _, lv in u1]
    assert [r[1] for r in by_rn] == list(range(1, 7)) and all(r[2] == 6 for r in by_rn)
    assert [r[3] for r in by_rn] == [None] + levels[:-1]
    assert [r[4] for r in by_rn] == levels[1:] + [None]


def test_pr_curve_of_clustered_and_unbounded_scores(spark):
    """Scores that crowd near 0, and some far outside [0, 1], against plain cumulative sums."""
    from attrition.operators.evaluate import pr_curve

    rng = np.random.default_rng(5)
    score = np.concatenate([1.0 / (1.0 + 1000.0 * np.arange(3000)), rng.choice([-7.0, 0.0, 12.5, 1e9], 200)])
    label = (rng.random(len(score)) < 0.3).astype(int)
    table = spark.createDataFrame(pd.DataFrame({"score": score, "label": label})).repartition(4)
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in pr_curve(table, "label", "score").collect()}
    want = {t: (int(((score >= t) & (label == 1)).sum()), int(((score >= t) & (label == 0)).sum())) for t in np.unique(score).tolist()}
    assert got == want
