"""Oracle SQL for splits and evaluators (deterministic score)."""

from __future__ import annotations

from oracle.features_sql import FEATURES
from oracle.sql import cte, query, r6

LABEL = "label_churn_horizon"
cte("scored", f"""  SELECT userId, date, CAST({LABEL} AS BIGINT) AS label, 1.0 / (1.0 + CAST("win7_events" AS DOUBLE)) AS score
  FROM feat""", ["feat"])
cte("curve0", """  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM scored WHERE score IS NOT NULL GROUP BY score""", ["scored"])
cte("curve", """  SELECT threshold, pos, neg,
         CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
         (SELECT sum(pos) FROM curve0) AS p_total
  FROM curve0""", ["curve0"])
cte("curve2", """  SELECT threshold, pos, neg, tp, fp, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
         CASE WHEN p_total = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / p_total END AS recall FROM curve""", ["curve"])

U = "('0x' || substr(md5(userId || '|' || CAST(date AS VARCHAR) || '|' || '42'), 1, 8))::BIGINT / 4294967296.0"
cte("ranked", f"""  SELECT userId, date, label, row_number() OVER (PARTITION BY label ORDER BY {U}, userId, date) AS r,
         count(*) OVER (PARTITION BY label) AS n FROM scored""", ["scored"])
query("stratified_split", "SELECT userId, date, label, CASE WHEN r <= floor(n * 0.7 + 0.5) THEN 'train' ELSE 'validation' END AS split FROM ranked", ["ranked"])
query("stratified_split_three_way", """SELECT userId, date, label, CASE WHEN r <= floor(n * 0.6::DOUBLE + 0.5) THEN 'train'
       WHEN r <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE) + 0.5) THEN 'validation' ELSE 'test' END AS split FROM ranked""", ["ranked"])
F48 = ", ".join(f'"{f}"' for f in FEATURES)
cte("split2", f"""  SELECT m.*, CASE WHEN row_number() OVER (PARTITION BY {LABEL} ORDER BY {U}, userId, date)
         <= floor(count(*) OVER (PARTITION BY {LABEL}) * 0.7 + 0.5) THEN 'train' ELSE 'validation' END AS split FROM matrix m""", ["matrix"])
query("training_job_counts", f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train_rows,
       count(*) FILTER (WHERE split = 'validation') AS n_validation_rows, 48::BIGINT AS n_features,
       {r6(f"(1.0 - avg({LABEL}) FILTER (WHERE split = 'train')) / greatest(avg({LABEL}) FILTER (WHERE split = 'train'), 1e-9)")} AS scale_pos_weight,
       {r6(f"avg({LABEL}) FILTER (WHERE split = 'train')")} AS pos_rate_train,
       {r6(f"avg({LABEL}) FILTER (WHERE split = 'validation')")} AS pos_rate_validation, count(*) AS scored_rows FROM split2""", ["split2"])
query("assemble_vector", f"""SELECT userId, date, {LABEL}, (unnest(range(48)))::INT AS place,
       unnest([{", ".join(r6(f'"{f}"') for f in FEATURES)}]) AS value FROM matrix""", ["matrix"])
query("predict_proba_range", f"SELECT userId, date, {LABEL}, true AS in_range FROM split2 WHERE split = 'validation'", ["split2"])
query("reload_check", f"""SELECT label, support, true AS same_counts FROM (SELECT count(*) FILTER (WHERE {LABEL} = 0) AS n0,
       count(*) FILTER (WHERE {LABEL} = 1) AS n1, count(*) AS n FROM split2 WHERE split = 'validation') t,
       LATERAL (SELECT unnest(['0', '1', 'accuracy', 'macro avg', 'weighted avg']) AS label, unnest([n0, n1, n, n, n]) AS support) r""", ["split2"])
query("score_requests_status", """SELECT r.user_id, r.date, CASE WHEN k.userId IS NULL THEN 'unknown_user' WHEN f.userId IS NULL THEN 'no_activity' ELSE 'ok' END AS status,
       true AS consistent
FROM req r LEFT JOIN afeat f ON f.userId = r.user_id AND f.date = CAST(r.date AS DATE)
LEFT JOIN (SELECT DISTINCT userId FROM ev WHERE userId IS NOT NULL) k ON k.userId = r.user_id""", ["req", "afeat", "ev"])
query("time_split", """SELECT userId, date, label,
       CASE WHEN date <= (SELECT max(date) FROM scored) - 1 THEN 'train' ELSE 'test' END AS split FROM scored""", ["scored"])
query("pr_curve", f"""SELECT {r6('threshold')} AS threshold, pos, neg, tp, fp, {r6('precision')} AS precision,
       {r6('recall')} AS recall FROM curve2""", ["curve2"])
query("average_precision", f"SELECT {r6('sum(pos * precision) / CAST(sum(pos) AS DOUBLE)')} AS average_precision FROM curve2", ["curve2"])
query("roc_auc", f"""SELECT {r6('CASE WHEN p * n > 0 THEN (p * n - a + b * 0.5) / (p * n) END')} AS roc_auc FROM (
  SELECT CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n,
         sum(CAST(pos AS DOUBLE) * CAST(fp AS DOUBLE)) AS a, sum(CAST(pos AS DOUBLE) * CAST(neg AS DOUBLE)) AS b FROM curve2) t""", ["curve2"])
cte("picked", """  SELECT coalesce(
    (SELECT min(threshold) FROM curve2 WHERE precision >= 0.7),
    (SELECT threshold FROM curve2 ORDER BY precision DESC, threshold ASC LIMIT 1),
    0.5) AS threshold,
    CASE WHEN (SELECT min(threshold) FROM curve2 WHERE precision >= 0.7) IS NOT NULL THEN 'precision_floor'
         WHEN (SELECT count(*) FROM curve2) > 0 THEN 'max_precision' ELSE 'default' END AS rule""", ["curve2"])
query("pick_threshold", f"SELECT {r6('threshold')} AS threshold, rule FROM picked", ["picked"])
for name, value in (("pick_threshold_sweep", "recall"), ("pick_threshold_sweep_f1", "2 * precision * recall / (precision + recall + 1e-9)")):
    kind = "recall" if name.endswith("sweep") else "f1"
    query(name, f"""SELECT {r6("coalesce(min(threshold), 0.5)")} AS threshold, '{kind}' AS maximize, {r6('max(v)')} AS value FROM (
  SELECT threshold, v FROM (SELECT threshold, {value} AS v FROM curve2 WHERE precision >= 0.4) t
  WHERE v = (SELECT max({value}) FROM curve2 WHERE precision >= 0.4)) t2""", ["curve2"])
cte("cm", """  SELECT count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= t) AS fp,
         count(*) FILTER (WHERE label <> 1 AND score < t) AS tn, count(*) FILTER (WHERE label = 1 AND score < t) AS fn
  FROM scored, (SELECT threshold AS t FROM picked) p""", ["scored", "picked"])


def frac(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


query("metrics_at_threshold", f"""SELECT {r6(frac('tp + tn', 'tp + fp + tn + fn'))} AS accuracy, {r6(frac('tp', 'tp + fp'))} AS precision,
       {r6(frac('tp', 'tp + fn'))} AS recall, {r6(frac('2 * tp', '2 * tp + fp + fn'))} AS f1, tp, fp, tn, fn FROM cm""", ["cm"])
P0, R0, F0 = frac("tn", "tn + fn"), frac("tn", "tn + fp"), frac("2 * tn", "2 * tn + fn + fp")
P1, R1, F1 = frac("tp", "tp + fp"), frac("tp", "tp + fn"), frac("2 * tp", "2 * tp + fp + fn")
N = "(tp + fp + tn + fn)"


def wavg(a: str, b: str) -> str:
    return frac(f"({a}) * (tn + fp) + ({b}) * (tp + fn)", N)


query("classification_report", f"""SELECT '0' AS label, {r6(P0)} AS precision, {r6(R0)} AS recall, {r6(F0)} AS f1_score, CAST(tn + fp AS BIGINT) AS support FROM cm
UNION ALL SELECT '1', {r6(P1)}, {r6(R1)}, {r6(F1)}, CAST(tp + fn AS BIGINT) FROM cm
UNION ALL SELECT 'accuracy', NULL, NULL, {r6(frac('tp + tn', N))}, CAST({N} AS BIGINT) FROM cm
UNION ALL SELECT 'macro avg', {r6(f'({P0} + {P1}) / 2')}, {r6(f'({R0} + {R1}) / 2')}, {r6(f'({F0} + {F1}) / 2')}, CAST({N} AS BIGINT) FROM cm
UNION ALL SELECT 'weighted avg', {r6(wavg(P0, P1))}, {r6(wavg(R0, R1))}, {r6(wavg(F0, F1))}, CAST({N} AS BIGINT) FROM cm""", ["cm"])
