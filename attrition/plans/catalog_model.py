"""Split and evaluation queries of the catalog.

The evaluators run on a deterministic score, ``1 / (1 + win7_events)``, so
the SQL oracle can recompute them; the model path (``train_gbt``,
``training_job`` ...) feeds the same functions with model probabilities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.config import LABEL, Params
from attrition.operators import evaluate as E
from attrition.operators.split import THREE_WAY, stratified_split, time_split
from attrition.plans.catalog import register
from attrition.plans.catalog_features import _train_feat

P = Params()


def _scored(s, d) -> DataFrame:
    x = _train_feat(s, d)
    return x.select(
        "userId", "date", F.col(LABEL).cast("long").alias("label"),
        (F.lit(1.0) / (F.lit(1.0) + F.col(f"win{P.recent_window}_events").cast("double"))).alias("score"),
    )


def _curve(s, d) -> DataFrame:
    return E.pr_curve(_scored(s, d), "label", "score")


def _picked(s, d):
    """The chosen threshold for the metric queries, as a scalar subquery."""
    return E.pick_threshold(_curve(s, d), P.precision_floor).select("threshold").scalar()


register("stratified_split")(lambda s, d: stratified_split(_scored(s, d), "label").select("userId", "date", "label", "split"))
register("stratified_split_three_way")(lambda s, d: stratified_split(_scored(s, d), "label", THREE_WAY).select("userId", "date", "label", "split"))
register("time_split")(lambda s, d: time_split(_scored(s, d), test_days=1).select("userId", "date", "label", "split"))
register("pr_curve")(_curve)
register("average_precision")(lambda s, d: E.average_precision(_curve(s, d)))
register("roc_auc")(lambda s, d: E.roc_auc(_curve(s, d)))
register("pick_threshold")(lambda s, d: E.pick_threshold(_curve(s, d), P.precision_floor))
register("pick_threshold_sweep")(lambda s, d: E.pick_threshold_sweep(_curve(s, d), 0.4, "recall"))
register("pick_threshold_sweep_f1")(lambda s, d: E.pick_threshold_sweep(_curve(s, d), 0.4, "f1"))
register("metrics_at_threshold")(lambda s, d: E.metrics_at_threshold(_scored(s, d), "label", "score", _picked(s, d)))
register("classification_report")(lambda s, d: E.classification_report(E.confusion(_scored(s, d), "label", "score", _picked(s, d))))
