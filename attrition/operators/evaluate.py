"""Binary-classifier evaluation as DataFrame aggregates.

The precision/recall curve needs, for every distinct score t, the positives
and negatives scored >= t. A global ``Window.orderBy(score)`` would run in a
single task; instead distinct scores are grouped by their leading bits (octave
and 1/256 of it), cumulated inside each group in parallel, and offset by prefix
sums over the table of groups. The groups depend on a score alone, so the scored
input is evaluated once. Exact and tie-aware for scores of any range; scores that
crowd near 0 spread over octaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of scores in an octave, and the octaves below 1 that a double reaches.
STEPS, OCTAVES = 256, 1100


def score_bucket(x: Column) -> Column:
    """An order-preserving group of a double: sign, power of two, and step within
    it. A power that ``log2`` rounds up gives the same group as the one below."""
    size = F.abs(x)
    octave = F.floor(F.log2(size)).cast("double")
    step = (octave + OCTAVES) * STEPS + F.floor(size / F.pow(F.lit(2.0), octave) * STEPS) - STEPS
    group = F.when(size == 0, F.lit(0.0)).when(size == float("inf"), F.lit(4.0 * OCTAVES * STEPS)).otherwise(step)
    return F.when(F.isnan(x), F.lit(5 * OCTAVES * STEPS)).otherwise((F.signum(x) * group).cast("long")).cast("long")


def _frac(num: Column, den: Column) -> Column:
    """num / den, 0.0 on 0/0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def class_balance(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Rows, positives, positive rate and the derived positive-class weight
    ``(1 - p) / max(p, 1e-9)``, for each value of the columns ``by``."""
    y = F.col(label)
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(y == 1).alias("positives"))
    p = F.try_divide(F.col("positives").cast("double"), F.col("rows"))
    return agg.select(
        *by, "rows", "positives", p.alias("pos_rate"),
        ((F.lit(1.0) - p) / F.greatest(p, F.lit(1e-9))).alias("scale_pos_weight"),
    )


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, pos, neg, tp, fp, precision, recall`` for each distinct
    score (prediction rule ``score >= threshold``)."""
    y = F.col(label)
    counts = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    )
    counts = counts.withColumn("_b", score_bucket(F.col("threshold")))
    inside = Window.partitionBy("_b").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_tp_in", F.sum("pos").over(inside)).withColumn("_fp_in", F.sum("neg").over(inside))
    buckets = counts.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    # windows over the table of groups only (a few thousand rows for scores between 0 and 1)
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select(
        "_b",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_tp_off"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_fp_off"),
        F.sum("_bp").over(every).alias("_p"),
    )
    curve = counts.join(buckets, "_b", "inner").select(
        "threshold", "pos", "neg", "_p",
        (F.col("_tp_off") + F.col("_tp_in")).alias("tp"),
        (F.col("_fp_off") + F.col("_fp_in")).alias("fp"),
    )
    return curve.select(
        "threshold", "pos", "neg", "tp", "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("_p")).alias("recall"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """Step-wise AP: sum over thresholds of (recall gain) x precision.
    Null without positives."""
    total = F.sum("pos")
    return curve.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), total.cast("double")).alias("average_precision")
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve (rank statistic, ties count 1/2); null when
    only one class is present. With P positives, N negatives and ``fp`` the
    negatives scored >= t: AUC = (N*P - sum(pos*fp) + sum(pos*neg)/2) / (N*P),
    one aggregate over the curve."""
    pos, neg, fp = (F.col(c).cast("double") for c in ("pos", "neg", "fp"))
    agg = curve.agg(
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"),
        F.sum(pos * fp).alias("_a"), F.sum(pos * neg).alias("_b"),
    )
    pn = F.col("_p") * F.col("_n")
    return agg.select(F.when(pn > 0, (pn - F.col("_a") + F.col("_b") * 0.5) / pn).alias("roc_auc"))


def pick_threshold(curve: DataFrame, precision_floor: float) -> DataFrame:
    """Highest recall whose precision reaches the floor. Recall never rises
    with the threshold, so that is the lowest threshold meeting the floor.
    Without one: the lowest threshold of maximal precision (the minimum of
    ``(-precision, threshold)``); 0.5 on an empty curve."""
    t, p = F.col("threshold"), F.col("precision")
    agg = curve.agg(
        F.min(F.when(p >= precision_floor, t)).alias("_ok"),
        F.min(F.struct((-p).alias("np"), t.alias("t"))).getField("t").alias("_best"),
    )
    rule = F.when(F.col("_ok").isNotNull(), F.lit("precision_floor")).when(
        F.col("_best").isNotNull(), F.lit("max_precision")
    ).otherwise(F.lit("default"))
    return agg.select(F.coalesce("_ok", "_best", F.lit(0.5)).alias("threshold"), rule.alias("rule"))


def pick_threshold_sweep(curve: DataFrame, min_precision: float, maximize: str = "recall") -> DataFrame:
    """Among thresholds with precision >= ``min_precision``, the lowest one
    maximising recall or F1 (``2pr / (p + r + 1e-9)``); 0.5 if none."""
    p, r = F.col("precision"), F.col("recall")
    value = r if maximize == "recall" else (2 * p * r) / (p + r + F.lit(1e-9))
    best = F.min(F.when(p >= min_precision, F.struct((-value).alias("nv"), F.col("threshold").alias("t"))))
    agg = curve.agg(best.alias("_b"))
    return agg.select(
        F.coalesce(F.col("_b.t"), F.lit(0.5)).alias("threshold"),
        F.lit(maximize).alias("maximize"),
        (-F.col("_b.nv")).alias("value"),
    )


def confusion(df: DataFrame, label: str, score: str, threshold: Column | float) -> DataFrame:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, yhat = F.col(label) == 1, F.col(score) >= thr
    return df.agg(
        F.count_if(y & yhat).alias("tp"),
        F.count_if(~y & yhat).alias("fp"),
        F.count_if(~y & ~yhat).alias("tn"),
        F.count_if(y & ~yhat).alias("fn"),
    )


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select(
        _frac(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _frac(tp, tp + fp).alias("precision"),
        _frac(tp, tp + fn).alias("recall"),
        _frac(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tp", "fp", "tn", "fn",
    )


def metrics_at_threshold(df: DataFrame, label: str, score: str, threshold: Column | float) -> DataFrame:
    return metrics_from_confusion(confusion(df, label, score, threshold))


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages, as rows (``label`` = 0, 1, accuracy, macro avg,
    weighted avg)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    p0, r0, f0, s0 = _frac(tn, tn + fn), _frac(tn, tn + fp), _frac(2 * tn, 2 * tn + fn + fp), tn + fp
    p1, r1, f1, s1 = _frac(tp, tp + fp), _frac(tp, tp + fn), _frac(2 * tp, 2 * tp + fp + fn), tp + fn
    acc = _frac(tp + tn, n)

    def wavg(a: Column, b: Column) -> Column:
        return _frac(a * s0 + b * s1, n)

    null = F.lit(None).cast("double")

    def row(name: str, p: Column, r: Column, f: Column, sup: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), sup.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", null, null, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n),
    )
    return cm.select(F.inline(rows)).select(
        "label", "precision", "recall", "f1_score", F.col("support").cast("long").alias("support")
    )
