"""Hand-made micro-fixtures for the semantic traps the benchmark data cannot
reach (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attrition.config import Params
from attrition.operators import churn as C
from attrition.operators import evaluate as E
from attrition.operators import explore as X
from attrition.operators import users as U
from attrition.operators.histogram import histogram
from attrition.plans.features import asof_features, user_day_features
from attrition.sources.events import corrupt_lines, load_events
from tests.conftest import BASE_MS, DAY, HOUR, event


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_loader_types_blank_and_malformed(spark, jsonl):
    path = jsonl([
        event("100024", BASE_MS, registration=1530000000000),
        '{"userId":"","sessionId":8,"ts":1539032700000,"registration":null,"page":"Home","level":"free"}',
        '{"userId": "7", "ts": ',
    ])
    ev = load_events(spark, path, blank_user="keep")
    assert dict(ev.dtypes)["userId"] == "string"
    assert dict(ev.dtypes)["datetime"] == "timestamp_ntz"
    got = sorted(rows(ev.filter(F.col("_corrupt_record").isNull()), "userId", "datetime"))
    assert got == [("", dt.datetime(2018, 10, 8, 21, 5)), ("100024", dt.datetime(2024, 1, 1))]
    assert len(corrupt_lines(ev).collect()) == 1
    evn = load_events(spark, path, blank_user="null")
    assert evn.filter(F.col("userId").isNull() & F.col("_corrupt_record").isNull()).count() == 1


def test_missing_file_is_error(spark):
    with pytest.raises(Exception):
        load_events(spark, "/nonexistent/events.json").count()


def test_null_user_dropped_in_exploration_kept_as_blank_in_pipeline(spark, jsonl):
    path = jsonl([event("1", BASE_MS), event("", BASE_MS + HOUR), event(None, BASE_MS + 2 * HOUR)])
    evn = load_events(spark, path, "null")
    assert rows(X.total_unique_users(evn), "total_users") == [(1,)]
    evk = load_events(spark, path, "keep")
    assert rows(X.events_profile(evk), "rows", "unique_users") == [(3, 2)]
    feat = user_day_features(evk)
    assert sorted(r[0] for r in rows(feat, "userId")) == ["", "1"]


def test_null_timestamp(spark, jsonl):
    path = jsonl([event("1", BASE_MS), event("1", None)])
    ev = load_events(spark, path)
    assert rows(X.events_profile(ev), "null_timestamps") == [(1,)]
    assert user_day_features(ev).count() == 1


def test_tie_uses_file_order(spark, jsonl):
    # same user and time; file order paid, Submit Downgrade, free
    path = jsonl([
        event("1", BASE_MS, "Home", "paid"),
        event("1", BASE_MS + HOUR, "Submit Downgrade", "paid"),
        event("1", BASE_MS + HOUR, "Home", "free"),
    ])
    ev = load_events(spark, path)
    assert C.churn_events(ev).count() == 1


def test_churn_at_edges_is_not_churn(spark, jsonl):
    path = jsonl([
        event("1", BASE_MS, "Submit Downgrade", "paid"),
        event("1", BASE_MS + HOUR, "Home", "free"),
        event("2", BASE_MS, "Home", "paid"),
        event("2", BASE_MS + HOUR, "Submit Downgrade", "paid"),
    ])
    assert C.churn_events(load_events(spark, path)).count() == 0


def test_early_event_floors_to_minus_one(spark, jsonl):
    path = jsonl([event("1", BASE_MS, registration=BASE_MS + HOUR)])
    assert rows(X.days_since_registration(load_events(spark, path)), "days_since_registration") == [(-1,)]


def test_no_songs_ratio_zero_and_gap_windows(spark, jsonl):
    path = jsonl([event("1", BASE_MS, "Thumbs Up"), event("1", BASE_MS + 19 * DAY, "Thumbs Up")])
    feat = user_day_features(load_events(spark, path)).orderBy("date")
    out = rows(feat, "date", "ratio_thumbs_up", "win7_events", "win14_events", "cum_events")
    assert len(out) == 20  # dense: day 1 .. day 20
    assert all(r[1] == 0.0 for r in out)
    assert out[10][2:] == (0.0, 1.0, 1.0)  # day 11: day 1 still inside the 14-day window
    assert out[14][2:] == (0.0, 0.0, 1.0)  # day 15: both windows empty
    assert out[-1][2:] == (1.0, 1.0, 2.0)


def test_churn_label_edges(spark, jsonl):
    # churn on day 10; rows exist day 1..10 (spine stops at the churn day)
    evs = [event("1", BASE_MS + d * DAY, "Home", "paid") for d in range(0, 9)]
    evs += [event("1", BASE_MS + 9 * DAY, "Submit Downgrade", "paid"), event("1", BASE_MS + 9 * DAY + HOUR, "Home", "free"),
            event("1", BASE_MS + 12 * DAY, "Home", "free")]
    feat = user_day_features(load_events(spark, jsonl(evs)), Params(horizon_days=5)).orderBy("date")
    lab = [r[0] for r in rows(feat, "label_churn_horizon")]
    assert len(lab) == 10  # day after churn absent
    assert lab[-1] == 0  # churn day itself
    assert lab[4] == 1 and lab[3] == 0  # date+5 counted, date+6 not


def test_gender_first_row_null_counts(spark, jsonl):
    path = jsonl([event("1", BASE_MS, gender=None), event("1", BASE_MS + HOUR, gender="F")])
    ev = load_events(spark, path)
    assert {r[0] for r in rows(user_day_features(ev), "gender_code")} == {-1.0}
    assert rows(U.user_features(ev), "gender_code") == [(-1.0,)]


def test_shared_session_spans_users(spark, jsonl):
    path = jsonl([event("1", BASE_MS, session=5), event("2", BASE_MS + 2 * HOUR, session=5)])
    assert rows(X.session_durations(load_events(spark, path)), "session_duration_min") == [(120.0,)]


def test_mode_tie_smallest_weekday_and_single_length(spark, jsonl):
    # 2024-01-01 is a Monday, 2024-01-03 a Wednesday
    path = jsonl([event("1", BASE_MS), event("1", BASE_MS + 2 * DAY, page="Home")])
    t = U.user_features(load_events(spark, path))
    assert rows(t, "most_common_day", "hearing_time_variance") == [(0.0, None)]


def test_constant_column_correlation_is_null(spark, jsonl):
    path = jsonl([event("1", BASE_MS), event("2", BASE_MS + HOUR), event("3", BASE_MS + 2 * HOUR)])
    corr = dict(rows(U.correlation_with(U.user_features(load_events(spark, path))), "feature", "corr"))
    assert corr["unique_pages"] is None  # zero variance: null, not an error


def test_odd_agent_no_browser(spark, jsonl):
    path = jsonl([event("1", BASE_MS, userAgent="curl/7.0")])
    assert rows(X.parse_user_agent(load_events(spark, path)), "browser", "os") == [(None, None)]


def test_histogram_max_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    h = rows(histogram(df, "x", 5).orderBy("bin"), "count")
    assert [c for (c,) in h] == [2, 1, 0, 0, 1]  # the max lands in the last bin
    const = rows(histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).orderBy("bin"), "lo", "count")
    assert const[2] == (3.0, 2)  # range 2.5 .. 3.5, value in the middle bin


def test_scores_ties_floor_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    curve = E.pr_curve(df, "label", "score")
    c = {r["threshold"]: (r["tp"], r["fp"]) for r in curve.collect()}
    assert c == {0.9: (1, 1), 0.5: (2, 1), 0.1: (2, 2)}
    # no threshold reaches 0.9 precision -> lowest threshold of max precision
    assert rows(E.pick_threshold(curve, 0.9), "threshold", "rule") == [(0.5, "max_precision")]
    # pairs (pos, neg): (.9,.9) tie 1/2, (.9,.1) 1, (.5,.9) 0, (.5,.1) 1 -> 2.5 / 4
    assert rows(E.roc_auc(curve), "roc_auc") == [(0.625,)]
    one = E.pr_curve(spark.createDataFrame([(0, 0.3), (0, 0.4)], "label int, score double"), "label", "score")
    assert rows(E.roc_auc(one), "roc_auc") == [(None,)]


def test_metric_self_check_against_stored_counts(spark):
    cm = spark.createDataFrame([(91, 39, 4794, 37)], "tp long, fp long, tn long, fn long")
    m = E.metrics_from_confusion(cm).first()
    assert round(m["accuracy"], 5) == 0.98468
    assert round(m["precision"], 4) == 0.7
    assert round(m["recall"], 4) == 0.7109
    assert round(m["f1"], 4) == 0.7054


def test_digit_users_stay_strings_and_bad_requests(spark, jsonl):
    path = jsonl([event("10", BASE_MS), event("10", BASE_MS + 2 * DAY), event("20", BASE_MS + 3 * DAY)])
    ev = load_events(spark, path)
    req = spark.createDataFrame(
        [("10", dt.datetime(2024, 1, 1, 12)), ("99", dt.datetime(2024, 1, 2)), ("20", dt.datetime(2024, 1, 2)),
         ("10", dt.datetime(2024, 1, 5, 12))],
        "user_id string, date timestamp_ntz",
    )
    out = {(r["user_id"], r["date"].day): (r["status"], r["cum_events"]) for r in asof_features(ev, req).collect()}
    assert out[("10", 1)] == ("ok", 1.0)  # event at 00:00 counted on a 12:00 request
    assert out[("99", 2)] == ("unknown_user", None)
    assert out[("20", 2)] == ("no_activity", None)
    assert out[("10", 5)] == ("ok", 2.0)  # spine runs past the last activity


def test_event_order_over_several_files_and_splits(spark, tmp_path):
    """Files by path, lines by place, however Spark packs and splits them."""
    import json

    from attrition.sources.events import load_events
    from tests.conftest import BASE_MS, event

    log = tmp_path / "log of events"
    log.mkdir()
    sizes = {"part-0.json": 1, "part-1.json": 400, "part-2.json": 3, "part-10.json": 250}
    for name, n in sizes.items():
        (log / name).write_text("".join(json.dumps(event(f"{name}/{i}", BASE_MS)) + "\n" for i in range(n)))
    want = [f"{name}/{i}" for name in sorted(sizes) for i in range(sizes[name])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in ("128m", "20000b", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = load_events(spark, str(log)).select("event_seq", "userId").collect()
            assert [r.userId for r in sorted(rows, key=lambda r: r.event_seq)] == want
            assert len({r.event_seq for r in rows}) == len(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_times_out_of_range_are_null(spark, jsonl):
    from attrition.sources.events import load_events
    from tests.conftest import BASE_MS, event

    path = jsonl([event("1", 9 * 10**18), event("2", -(9 * 10**18)), event("3", BASE_MS + 1, registration=253_402_300_800_000), event("4", None)])
    got = {r.userId: (r.datetime, r.registration_datetime) for r in load_events(spark, path).collect()}
    assert got["1"][0] is None and got["2"][0] is None and got["4"][0] is None
    assert got["3"][0].microsecond == 1000 and got["3"][1] is None


def test_registration_of_an_event_without_a_time_counts(spark, jsonl):
    from attrition.plans.features import user_day_features
    from attrition.sources.events import load_events
    from tests.conftest import BASE_MS, DAY, event

    path = jsonl([event("1", BASE_MS, registration=BASE_MS - 2 * DAY), event("1", None, registration=BASE_MS - 9 * DAY)])
    rows = user_day_features(load_events(spark, path)).select("days_since_join").collect()
    assert [r.days_since_join for r in rows] == [9.0]


def test_other_levels_have_columns_of_their_own(spark, jsonl):
    from attrition.operators.explore import page_by_level, page_by_level_pct
    from attrition.sources.events import load_events
    from tests.conftest import BASE_MS, event

    ev = load_events(spark, jsonl([event("1", BASE_MS, "Home", level=x) for x in ("free", "paid", "trial", "trial", None)] + [event("2", BASE_MS, "Error", level="trial")]))
    got = {r.page: r.asDict() for r in page_by_level(ev).collect()}
    assert got["Home"] == {"page": "Home", "free": 1, "paid": 1, "trial": 2, "total": 4}
    assert got["Error"]["trial"] == 1 and {r.page: r.trial_pct for r in page_by_level_pct(ev).collect()} == {"Home": 50.0, "Error": 100.0}


def test_event_log_is_written_by_as_many_tasks_as_a_shuffle_has(spark, jsonl, tmp_path):
    from attrition.sources.events import load_events, write_event_log

    ev = load_events(spark, jsonl([event("1", BASE_MS + 1000 * i) for i in range(400)]))
    path = str(tmp_path / "log")
    write_event_log(ev, path)
    back = load_events(spark, path)
    assert len(back.inputFiles()) > 4
    assert [r.datetime for r in back.orderBy("event_seq").collect()] == [r.datetime for r in ev.orderBy("event_seq").collect()]
