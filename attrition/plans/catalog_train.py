"""Model queries of the catalog (rows-only checks: model scores are not
SQL-reproducible).

Training runs once per Spark application, data directory and parameters, with
the full number of rounds; each run writes to a folder of its own under the
session's shared checkpoint folder. Every query reads the tables and returns
rows computed from them with what the run saved.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import LABEL, Params, feature_names
from attrition.operators import evaluate as E
from attrition.operators.split import stratified_split
from attrition.plans.boost import predict_proba
from attrition.plans.catalog import ev_keep, register
from attrition.plans.features import asof_features, asof_features_stored, user_day_features
from attrition.plans.scoring import filter_user_asof, requests_from_events, score_requests
from attrition.plans.training import assemble_vector, training_job
from attrition.session import local_rows, run_dir
from attrition.sources import bundle as B
from attrition.sources.user_days import append_user_days

P = Params()


@dataclass
class Run:
    folder: str
    run_id: str
    report: dict


_RUNS: dict[tuple, Run] = {}


def trained(spark: SparkSession, sf_dir: str, params: Params | None = None) -> Run:
    """The training job's run on ``sf_dir`` in this application."""
    params = params or P
    key = (spark.sparkContext.applicationId, sf_dir, params)
    if key not in _RUNS:
        run_id = uuid.uuid4().hex
        folder = run_dir(spark, "attrition-model")
        report = training_job(spark, ev_keep(spark, sf_dir), folder, params, run_id=run_id).first().asDict()
        _RUNS[key] = Run(folder, run_id, report)
    return _RUNS[key]


def _matrix(s, d) -> DataFrame:
    return user_day_features(ev_keep(s, d), P)


def _bundle(s, d) -> B.Bundle:
    return B.load_model_bundle(s, f"{trained(s, d).folder}/bundle")


def _feature_sums(s, d) -> DataFrame:
    """``feature, nonzero``: rows of the feature table where it isn't zero."""
    feats = feature_names(P)
    counts = _matrix(s, d).agg(*[F.count_if(F.col(f"`{f}`") != 0).alias(f"c{i}") for i, f in enumerate(feats)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("nonzero")) for i, f in enumerate(feats)])))


def _recounted(s, d) -> DataFrame:
    """``key, recounted``: the run's counts, taken from the tables again."""
    split = stratified_split(_matrix(s, d), LABEL, seed=P.seed)
    n = split.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "train").alias("n_train_rows"), F.count_if(F.col("split") == "validation").alias("n_validation_rows"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("recounted")) for c in n.columns])))


def _validation(s, d) -> DataFrame:
    return stratified_split(_matrix(s, d), LABEL, seed=P.seed).filter(F.col("split") == "validation")


@register("training_job")
def _training(s, d):
    """The run's report beside the row counts taken from the tables again."""
    run = trained(s, d)
    counts = _recounted(s, d).groupBy().pivot("key", ["n_rows", "n_train_rows", "n_validation_rows"]).agg(F.first("recounted"))
    counts = counts.select(*[F.col(c).alias(f"recounted_{c}") for c in counts.columns])
    return counts.select(*[F.lit(v).alias(k) for k, v in run.report.items()], *counts.columns)


@register("training_job_counts")
def _training_counts(s, d):
    """What of the run's report doesn't depend on the model."""
    run = trained(s, d)
    one = _recounted(s, d).agg(F.count(F.lit(1)).alias("_n"))
    keys = ("n_rows", "n_train_rows", "n_validation_rows", "n_features", "scale_pos_weight", "pos_rate_train", "pos_rate_validation")
    scored = sum(run.report[f"{p}_{c}"] for p in ("train", "val") for c in ("tp", "fp", "tn", "fn"))
    return one.select(*[F.lit(run.report[k]).alias(k) for k in keys], F.lit(scored).cast("long").alias("scored_rows"))


@register("assemble_vector")
def _assemble(s, d):
    """The model's input vector, a row for each place in it."""
    x = assemble_vector(_matrix(s, d), feature_names(P))
    return x.select("userId", "date", LABEL, F.posexplode(vector_to_array("features")).alias("place", "value"))


@register("train_gbt")
def _train_gbt(s, d):
    """Feature importances of the fitted boosted trees, with the feature's non-zero rows."""
    model = _bundle(s, d).model
    return local_rows(s, model.importances(), "feature string, importance double").join(_feature_sums(s, d), "feature")


@register("predict_proba")
def _predict(s, d):
    return predict_proba(_bundle(s, d).model, _validation(s, d)).select("userId", "date", LABEL, "probability")


@register("predict_proba_range")
def _predict_range(s, d):
    """Each validation row with whether its probability lies between 0 and 1."""
    p = F.col("probability")
    return predict_proba(_bundle(s, d).model, _validation(s, d)).select("userId", "date", LABEL, ((p >= 0) & (p <= 1)).alias("in_range"))


@register("save_model_bundle")
def _save_bundle(s, d):
    """Saves the run's bundle to a new folder, reloads it, and scores the
    validation rows with both: the probabilities and whether they agree."""
    old, copy = _bundle(s, d), f"{trained(s, d).folder}/copy-{uuid.uuid4().hex}"
    B.save_model_bundle(s, copy, old.model, old.threshold, old.features)
    new, rows = B.load_model_bundle(s, copy), _validation(s, d)
    scored = predict_proba(new.model, predict_proba(old.model, rows).withColumnRenamed("probability", "saved"))
    return scored.select("userId", "date", "saved", F.col("probability").alias("reloaded"), (F.col("saved") == F.col("probability")).alias("same"))


@register("load_model_bundle")
def _load_bundle(s, d):
    """The bundle's ordered features and threshold, with each feature's non-zero rows."""
    return B.bundle_table(s, _bundle(s, d)).join(_feature_sums(s, d), "feature")


@register("save_run_metadata")
def _metadata(s, d):
    """The saved metadata as key and value, beside the counts taken from the tables again."""
    text = s.read.json(f"{trained(s, d).folder}/metadata").select(F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    return text.join(_recounted(s, d), "key", "left")


@register("log_run")
def _log(s, d):
    """What the run logged, beside the counts taken from the tables again."""
    run = trained(s, d)
    return B.read_run_log(s, f"{run.folder}/runs", run.run_id).drop("run_id", "logged_at").join(_recounted(s, d), "key", "left")


@register("score_requests")
def _score(s, d):
    ev = ev_keep(s, d)
    return score_requests(ev, requests_from_events(ev), _bundle(s, d), P)


@register("score_requests_status")
def _score_status(s, d):
    """Each request with its status, and whether it has a label exactly if it is ok."""
    ev = ev_keep(s, d)
    scored = score_requests(ev, requests_from_events(ev), _bundle(s, d), P)
    return scored.select("user_id", "date", "status", (F.col("label").isNotNull() == (F.col("status") == "ok")).alias("consistent"))


@register("reload_check")
def _reload(s, d):
    """Reloads the saved bundle and rescores the validation rows at the saved
    threshold: the report's supports, and whether the counts are those that the
    training run reported."""
    bundle, run = _bundle(s, d), trained(s, d)
    scored = predict_proba(bundle.model, _validation(s, d)).select(F.col(LABEL).alias("label"), "probability")
    cm = E.confusion(scored, "label", "probability", bundle.threshold)
    same = F.lit(True)
    for c in ("tp", "fp", "tn", "fn"):
        same = same & (cm.select(c).scalar() == F.lit(run.report[f"val_{c}"]))
    return E.classification_report(cm).select("label", "support").withColumn("same_counts", same)


@register("asof_features")
def _asof(s, d):
    ev = ev_keep(s, d)
    return asof_features(ev, requests_from_events(ev), P)


_STORES: dict[tuple[str, str], str] = {}


def _user_days(s, d) -> str:
    """The tables' user-days, stored once per application in two batches of days."""
    key = (s.sparkContext.applicationId, d)
    if key not in _STORES:
        ev, folder = ev_keep(s, d), run_dir(s, "user-days")
        half = ev.agg((F.min(F.unix_date("date")) + F.max(F.unix_date("date"))) / 2).first()[0]
        later = F.coalesce(F.unix_date("date") > F.lit(half), F.lit(False))
        append_user_days(ev.filter(~later), folder, "first")
        append_user_days(ev.filter(later), folder, "second")
        _STORES[key] = folder
    return _STORES[key]


@register("asof_features_stored")
def _asof_stored(s, d):
    """``asof_features`` from stored user-days."""
    return asof_features_stored(s, _user_days(s, d), requests_from_events(ev_keep(s, d)), P)


@register("filter_user_asof")
def _visible(s, d):
    ev = ev_keep(s, d)
    return filter_user_asof(ev, requests_from_events(ev))
