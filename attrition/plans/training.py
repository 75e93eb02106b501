"""Train, evaluate and persist the churn classifier: second-order boosted trees
(``plans/boost.py``) with a positive-class weight."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import LABEL, Params, feature_names
from attrition.operators import evaluate as E
from attrition.operators.split import stratified_split, time_split
from attrition.plans.boost import predict_proba, train_gbt
from attrition.plans.features import user_day_features
from attrition.session import checkpoint_dir, local_rows
from attrition.sources import bundle as B


def assemble_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def _row(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r is not None else {}


def training_job(
    spark: SparkSession,
    ev: DataFrame,
    out_dir: str,
    params: Params = Params(),
    train_fraction: float = 0.7,
    run_id: str | None = None,
    test_days: int | None = None,
) -> DataFrame:
    """features -> split -> fit -> threshold -> metrics -> persist.

    The feature table is checkpointed (reliable checkpoint in the shared
    ``spark.checkpoint.dir``) so the iterative fit and the evaluations do
    not replay the event-level lineage, and an executor loss recomputes from
    the checkpoint. Each part is scored once, into a checkpoint too. All that
    a run writes lies under ``out_dir``, which must be a folder of its own; called
    again with the same folder, an interrupted fit goes on where it stopped.
    With ``test_days`` the last days of the calendar are the validation part
    instead of a random share (the report is then not flattered by rows of the
    same user on both sides). Returns a one-row report."""
    checkpoint_dir(spark)
    run_id = run_id or uuid.uuid4().hex
    feats = feature_names(params)
    parts = (("train", train_fraction), ("validation", 1 - train_fraction))
    rows = user_day_features(ev, params)
    if test_days is None:
        rows = stratified_split(rows, LABEL, parts, seed=params.seed)
    else:
        rows = time_split(rows, test_days).replace("test", "validation", "split")
    table = rows.checkpoint(eager=True)
    balance = {r["split"]: r.asDict() for r in E.class_balance(table, LABEL, "split").collect()}
    bal = balance["train"]
    spw = params.scale_pos_weight if params.scale_pos_weight is not None else bal["scale_pos_weight"]
    model = train_gbt(table, feats, LABEL, spw, params, f"{out_dir}/fit")

    scored = predict_proba(model, table).select("split", F.col(LABEL).alias("label"), "probability").checkpoint(eager=True)
    tr_p, va_p = (scored.filter(F.col("split") == x) for x in ("train", "validation"))
    curve = E.pr_curve(va_p, "label", "probability").checkpoint(eager=True)
    ap = _row(E.average_precision(curve))["average_precision"]
    thr = float(_row(E.pick_threshold(curve, params.precision_floor))["threshold"])
    m_tr = _row(E.metrics_at_threshold(tr_p, "label", "probability", thr))
    m_va = _row(E.metrics_at_threshold(va_p, "label", "probability", thr))
    reports = {
        name: [r.asDict() for r in E.classification_report(E.confusion(p, "label", "probability", thr)).collect()]
        for name, p in (("train", tr_p), ("validation", va_p))
    }

    n_val = int(balance.get("validation", {"rows": 0})["rows"])
    report = {
        "threshold": thr,
        "scale_pos_weight": float(spw),
        "pos_rate_train": bal["pos_rate"],
        "pos_rate_validation": balance.get("validation", {"pos_rate": None})["pos_rate"],
        "val_pr_auc": ap,
        "val_roc_auc": _row(E.roc_auc(curve))["roc_auc"],
        **{f"val_{k}": v for k, v in m_va.items()},
        **{f"train_{k}": v for k, v in m_tr.items()},
        "n_rows": int(bal["rows"]) + n_val,
        "n_train_rows": int(bal["rows"]),
        "n_validation_rows": n_val,
        "n_features": len(feats),
        "rounds": len(model.trees),
        "train_logloss": model.losses[-1][0] if model.losses else None,
        "val_logloss": model.losses[-1][1] if model.losses else None,
    }
    B.save_model_bundle(spark, f"{out_dir}/bundle", model, thr, feats)
    B.save_run_metadata(spark, f"{out_dir}/metadata", {**report, **asdict(params), "classification_report": reports, "logloss_by_round": model.losses})
    B.log_run(spark, f"{out_dir}/runs", {**asdict(params), "train_fraction": train_fraction, "scale_pos_weight": float(spw)}, report, run_id)
    return report_frame(spark, report)


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    """One-row DataFrame of a metrics dict (counts as long, the rest double)."""
    counts = {"n_rows", "n_train_rows", "n_validation_rows", "n_features", "rounds"} | {f"{p}_{c}" for p in ("val", "train") for c in ("tp", "fp", "tn", "fn")}
    fields = ", ".join(f"{k} {'long' if k in counts else 'double'}" for k in report)
    row = tuple(None if v is None else (int(v) if k in counts else float(v)) for k, v in report.items())
    return local_rows(spark, [row], fields)
