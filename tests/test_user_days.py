"""Stored user-days: same answers as the event log, batch by batch, reading little."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attrition.config import Params
from attrition.plans.features import asof_features, asof_features_stored
from attrition.plans.scoring import requests_from_events, score_requests, score_requests_stored
from attrition.plans.training import training_job
from attrition.session import Storage
from attrition.sources.bundle import load_model_bundle
from attrition.sources.events import events_from_tables, load_events
from attrition.sources.user_days import append_user_days, batches, bucket_of, read_user_days
from tests.conftest import BASE_MS, DAY, HOUR, SF_SMALL, event

SPLIT = dt.date(2024, 1, 16)


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    return events_from_tables(spark, SF_SMALL, "keep")


@pytest.fixture(scope="module")
def folder(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("user-days"))
    append_user_days(log.filter(F.col("date") < F.lit(SPLIT)), path, "early", 4)
    append_user_days(log.filter(F.col("date") >= F.lit(SPLIT)), path, "late", 4)
    return path


def test_answers_equal_those_from_the_log(spark, log, folder):
    asked = requests_from_events(log)
    assert rows(asof_features_stored(spark, folder, asked, buckets=4)) == rows(asof_features(log, asked))


def test_a_later_batch_changes_what_it_may(spark, log, tmp_path):
    """Requests up to a day have the same answer before and after later days are appended."""
    asked = requests_from_events(log).filter(F.col("date") < F.lit(SPLIT))
    append_user_days(log.filter(F.col("date") < F.lit(SPLIT)), str(tmp_path), "early", 4)
    before = rows(asof_features_stored(spark, str(tmp_path), asked, buckets=4))
    append_user_days(log.filter(F.col("date") >= F.lit(SPLIT)), str(tmp_path), "late", 4)
    after = rows(asof_features_stored(spark, str(tmp_path), asked, buckets=4))
    known_later = [a for b, a in zip(before, after) if b != a]
    assert len(before) == len(after) and all(a[2] == "no_activity" for a in known_later)
    assert [a for a in after if a[2] == "ok"] == [b for b in before if b[2] == "ok"]


def test_only_asked_buckets_and_days_are_read(spark, log, folder):
    user = log.select(F.min("userId")).first()[0]
    asked = spark.createDataFrame([(user, dt.datetime(2024, 1, 5, 12))], "user_id string, date timestamp_ntz")
    frame = asof_features_stored(spark, folder, asked, buckets=4)
    assert [r.status for r in frame.collect()] == ["ok"]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("batch=")[1] for f in asof_files(spark, folder, user)}
    everything = read_user_days(spark, folder, 4).inputFiles()
    assert 0 < len(files) <= 5 < len(everything)


def asof_files(spark, folder, user):
    """Files of the user's bucket up to the asked day."""
    bucket = spark.range(1).select(bucket_of(F.lit(user), 4)).first()[0]
    days = read_user_days(spark, folder, 4).filter((F.col("bucket") == bucket) & (F.col("date") <= F.lit(dt.date(2024, 1, 5))))
    return {r[0] for r in days.select(F.input_file_name()).distinct().collect()}


def test_a_batch_may_be_repeated_but_no_day_twice(spark, log, folder):
    asked = requests_from_events(log)
    want = rows(read_user_days(spark, folder, 4))
    append_user_days(log.filter(F.col("date") >= F.lit(SPLIT)), folder, "late", 4)
    assert rows(read_user_days(spark, folder, 4)) == want and batches(spark, folder, 4) == ["early", "late"]
    with pytest.raises(ValueError, match="2024-01-15"):
        append_user_days(log.filter(F.col("date") >= F.lit(dt.date(2024, 1, 15))), folder, "later", 4)
    assert rows(read_user_days(spark, folder, 4)) == want and asked.count() > 0


def test_a_torn_batch_is_not_read(spark, log, tmp_path):
    path = str(tmp_path)
    append_user_days(log.filter(F.col("date") < F.lit(SPLIT)), path, "early", 4)
    want = rows(read_user_days(spark, path, 4))
    append_user_days(log.filter(F.col("date") >= F.lit(SPLIT)), path, "late", 4)
    Storage(spark, path).delete(f"{path}/buckets=4/batch=late/_SUCCESS")
    assert rows(read_user_days(spark, path, 4)) == want and batches(spark, path, 4) == ["early"]


def test_undated_events_unknown_users_no_requests_and_an_empty_store(spark, jsonl, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no user-days"):
        read_user_days(spark, path)
    lines = [event("1", BASE_MS), event("1", BASE_MS + DAY + HOUR), event("2", None), event(None, BASE_MS), event("", BASE_MS + HOUR)]
    ev = load_events(spark, jsonl(lines))
    append_user_days(ev.filter(F.coalesce(F.col("date") <= dt.date(2024, 1, 1), F.lit(True))), path, "a")
    append_user_days(ev.filter(F.col("date") > dt.date(2024, 1, 1)), path, "b")
    append_user_days(ev.limit(0), path, "empty")
    at = dt.datetime(2024, 1, 2, 1)
    asked = spark.createDataFrame([("1", at), ("2", at), ("3", at), (None, at), ("", at), ("1", None)], "user_id string, date timestamp_ntz")
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted((tuple(r) for r in asof_features_stored(spark, path, asked).collect()), key=key)
    assert got == sorted((tuple(r) for r in asof_features(ev, asked).collect()), key=key)
    assert {r[0]: r[2] for r in got if r[1]} == {"1": "ok", "2": "no_activity", "3": "unknown_user", None: "unknown_user", "": "ok"}
    assert asof_features_stored(spark, path, asked.limit(0)).collect() == []


def test_scores_equal_those_from_the_log(spark, log, folder, tmp_path):
    training_job(spark, log, str(tmp_path), Params(rounds=3)).collect()
    bundle, asked = load_model_bundle(spark, f"{tmp_path}/bundle"), requests_from_events(log)
    got = rows(score_requests_stored(spark, folder, asked, bundle, buckets=4))
    assert got == rows(score_requests(log, asked, bundle)) and any(r[2] is not None for r in got)
