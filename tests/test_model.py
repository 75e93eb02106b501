"""Training job, bundle round trip and batch scoring (rows-only: model
scores are not SQL-reproducible)."""

import os
import tempfile

from pyspark.sql import functions as F

from attrition.config import FEATURES, LABEL, Params
from attrition.operators import evaluate as E
from attrition.operators.split import stratified_split
from attrition.plans.features import user_day_features
from attrition.plans.scoring import requests_from_events, score_requests
from attrition.plans.training import predict_proba, training_job
from attrition.session import checkpoint_dir
from attrition.sources import bundle as B
from attrition.sources.events import events_from_tables
from tests.conftest import SF_SMALL


def test_train_save_reload_rescore(spark):
    out = tempfile.mkdtemp(prefix="model-", dir=checkpoint_dir(spark).replace("file:", ""))
    ev = events_from_tables(spark, SF_SMALL, "keep")
    report = training_job(spark, ev, out, Params(rounds=3)).first().asDict()
    assert report["n_features"] == 48
    assert report["val_tp"] + report["val_fp"] + report["val_tn"] + report["val_fn"] > 0
    assert 0.0 <= report["threshold"] <= 1.0

    bundle = B.load_model_bundle(spark, f"{out}/bundle")
    assert bundle.features == FEATURES
    assert abs(bundle.threshold - report["threshold"]) < 1e-12
    # rescoring the validation rows with the reloaded bundle gives the same confusion counts
    val = stratified_split(user_day_features(ev), LABEL, seed=42).filter(F.col("split") == "validation")
    scored = predict_proba(bundle.model, val).select(F.col(LABEL).alias("label"), "probability")
    cm = E.confusion(scored, "label", "probability", bundle.threshold).first()
    assert (cm["tp"], cm["fp"], cm["tn"], cm["fn"]) == (report["val_tp"], report["val_fp"], report["val_tn"], report["val_fn"])

    runs = B.read_run_log(spark, f"{out}/runs")
    assert runs.filter(F.col("key") == "val_pr_auc").count() == 1


def test_training_on_earlier_days(spark):
    out = tempfile.mkdtemp(prefix="model-", dir=checkpoint_dir(spark).replace("file:", ""))
    ev = events_from_tables(spark, SF_SMALL, "keep")
    report = training_job(spark, ev, out, Params(rounds=2), test_days=5).first().asDict()
    days = user_day_features(ev).groupBy("date").count().collect()
    last = max(r["date"] for r in days)
    late = sum(r["count"] for r in days if (last - r["date"]).days < 5)
    assert report["n_validation_rows"] == late == sum(report[f"val_{c}"] for c in ("tp", "fp", "tn", "fn"))


def test_a_registered_model_query_as_registered(spark):
    """With the full number of rounds, as the catalog has it."""
    from attrition.plans import catalog_train
    from attrition.plans.catalog import queries
    from oracle.compare import compare, duck
    from oracle.sql import oracle_queries

    assert catalog_train.P == Params() and Params().rounds == 1000
    r = compare(queries()["training_job_counts"](spark, SF_SMALL), duck(SF_SMALL), oracle_queries()["training_job_counts"])
    assert r["values_match"] and r["spark_rows"] == r["oracle_rows"] == 1, r
    run = catalog_train.trained(spark, SF_SMALL)
    assert run.report["rounds"] == 1000 == len(B.load_model_bundle(spark, f"{run.folder}/bundle").model.trees)


def test_missing_bundle_part_is_error(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        B.load_model_bundle(spark, str(tmp_path / "nothing"))


def test_score_requests_statuses(spark):
    out = tempfile.mkdtemp(prefix="model-", dir=checkpoint_dir(spark).replace("file:", ""))
    ev = events_from_tables(spark, SF_SMALL, "keep")
    training_job(spark, ev, out, Params(rounds=2))
    bundle = B.load_model_bundle(spark, f"{out}/bundle")
    req = requests_from_events(ev).unionByName(
        spark.createDataFrame([("no-such-user", None)], "user_id string, date timestamp_ntz")
        .withColumn("date", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    )
    res = score_requests(ev, req, bundle)
    by = {r["status"]: r["n"] for r in res.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = requests_from_events(ev).count()  # a third each: ok, before any activity, unknown id
    assert by == {"ok": asked // 3, "no_activity": asked // 3, "unknown_user": asked // 3 + 1}
    assert res.filter((F.col("status") == "ok") & F.col("probability").isNull()).count() == 0
    assert res.filter((F.col("status") != "ok") & F.col("probability").isNotNull()).count() == 0
