"""Oracle SQL for the per-user table, correlations and histograms."""

from __future__ import annotations

from itertools import combinations_with_replacement

from oracle.sql import ORDER, cte, floor_days, query, r6

BROWSER = "NULLIF(regexp_extract(userAgent, '(Firefox|Chrome|Safari|Edge|MSIE|Opera)', 1), '')"
OS = "NULLIF(regexp_extract(userAgent, '(Windows|Macintosh|Linux|iPhone|Android)', 1), '')"
USER_COLUMNS = [
    "gender_code", "account_age_days", "total_events", "total_sessions", "unique_pages", "unique_days_active",
    "events_per_session", "total_hearing_time", "mean_hearing_time", "hearing_time_variance",
    "hearing_time_change_rate", "unique_user_agents", "unique_browsers", "unique_os", "avg_hour_active",
    "most_common_day", "avg_day_of_month", "days_since_last_activity", "activity_change_rate", "paid_event_share",
    "time_to_churn_days", "is_churned_user",
]

cte(
    "ubase",
    f"""  SELECT userId, min(datetime) AS first_ts, max(datetime) AS last_ts, count(*) AS total_events,
         count(DISTINCT sessionId) AS total_sessions, count(DISTINCT page) AS unique_pages,
         count(DISTINCT date) AS unique_days_active, sum(length) AS total_hearing_time,
         avg(length) AS mean_hearing_time, var_samp(length) AS hearing_time_variance,
         count(DISTINCT userAgent) AS unique_user_agents, count(DISTINCT {BROWSER}) AS unique_browsers,
         count(DISTINCT {OS}) AS unique_os, avg(hour(datetime)) AS avg_hour_active,
         avg(day(datetime)) AS avg_day_of_month,
         avg(CASE WHEN level = 'paid' THEN 1.0 ELSE 0.0 END) AS paid_event_share
  FROM evn WHERE userId IS NOT NULL GROUP BY userId""",
    ["evn"],
)
cte(
    "umode",
    """  SELECT userId, min(wd) AS most_common_day FROM (
    SELECT userId, wd, c, max(c) OVER (PARTITION BY userId) AS mc FROM (
      SELECT userId, isodow(datetime) - 1 AS wd, count(*) AS c FROM evn
      WHERE userId IS NOT NULL AND datetime IS NOT NULL GROUP BY 1, 2) t) t2
  WHERE c = mc GROUP BY userId""",
    ["evn"],
)
cte(
    "uthirds",
    f"""  SELECT userId, CASE WHEN n >= 3 AND s_avg <> 0 THEN (e_avg - s_avg) / s_avg END AS hearing_time_change_rate FROM (
    SELECT userId, max(n) AS n,
           avg(CASE WHEN rn <= n // 3 THEN length END) AS s_avg,
           avg(CASE WHEN rn > n - n // 3 THEN length END) AS e_avg
    FROM (SELECT userId, length, row_number() OVER w AS rn, count(*) OVER (PARTITION BY userId) AS n
          FROM evn WHERE userId IS NOT NULL AND length IS NOT NULL
          WINDOW w AS (PARTITION BY userId ORDER BY {ORDER})) t
    GROUP BY userId) t2""",
    ["evn"],
)
cte(
    "uhalves",
    f"""  SELECT userId, CASE WHEN n >= 4 AND r1 <> 0 THEN (r2 - r1) / r1 END AS activity_change_rate FROM (
    SELECT userId, max(n) AS n,
      CAST(count(CASE WHEN rn <= n // 2 THEN date END) AS DOUBLE) / NULLIF(count(DISTINCT CASE WHEN rn <= n // 2 THEN date END), 0) AS r1,
      CAST(count(CASE WHEN rn > n // 2 THEN date END) AS DOUBLE) / NULLIF(count(DISTINCT CASE WHEN rn > n // 2 THEN date END), 0) AS r2
    FROM (SELECT userId, date, row_number() OVER w AS rn, count(*) OVER (PARTITION BY userId) AS n
          FROM evn WHERE userId IS NOT NULL WINDOW w AS (PARTITION BY userId ORDER BY {ORDER})) t
    GROUP BY userId) t2""",
    ["evn"],
)
cte(
    "utable",
    f"""  SELECT b.userId,
    CAST(CASE f.gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS DOUBLE) AS gender_code,
    CAST({floor_days('b.last_ts', 'f.registration_datetime')} AS DOUBLE) AS account_age_days,
    CAST(b.total_events AS DOUBLE) AS total_events,
    CAST(b.total_sessions AS DOUBLE) AS total_sessions,
    CAST(b.unique_pages AS DOUBLE) AS unique_pages,
    CAST(b.unique_days_active AS DOUBLE) AS unique_days_active,
    CAST(b.total_events AS DOUBLE) / NULLIF(b.total_sessions, 0) AS events_per_session,
    b.total_hearing_time, b.mean_hearing_time, b.hearing_time_variance,
    t.hearing_time_change_rate,
    CAST(b.unique_user_agents AS DOUBLE) AS unique_user_agents,
    CAST(b.unique_browsers AS DOUBLE) AS unique_browsers,
    CAST(b.unique_os AS DOUBLE) AS unique_os,
    b.avg_hour_active,
    CAST(m.most_common_day AS DOUBLE) AS most_common_day,
    b.avg_day_of_month,
    CAST({floor_days('(SELECT max(datetime) FROM evn)', 'b.last_ts')} AS DOUBLE) AS days_since_last_activity,
    h.activity_change_rate,
    CAST(b.paid_event_share AS DOUBLE) AS paid_event_share,
    CAST({floor_days('c.churn_ts', 'b.first_ts')} AS DOUBLE) AS time_to_churn_days,
    CASE WHEN c.userId IS NOT NULL THEN 1.0 ELSE 0.0 END AS is_churned_user
  FROM ubase b
  LEFT JOIN first_row_n f ON b.userId = f.userId
  LEFT JOIN umode m ON b.userId = m.userId
  LEFT JOIN uthirds t ON b.userId = t.userId
  LEFT JOIN uhalves h ON b.userId = h.userId
  LEFT JOIN churn_tsn c ON b.userId = c.userId""",
    ["ubase", "first_row_n", "umode", "uthirds", "uhalves", "churn_tsn", "evn"],
)
query("user_features", "SELECT userId, " + ", ".join(f"{r6(c)} AS {c}" for c in USER_COLUMNS) + " FROM utable", ["utable"])
query("position_thirds", f"SELECT userId, {r6('hearing_time_change_rate')} AS length_thirds_change FROM uthirds", ["uthirds"])
query("position_halves", f"SELECT userId, {r6('activity_change_rate')} AS activity_change_rate FROM uhalves", ["uhalves"])
query("first_row_per_user", "SELECT userId, gender, registration_datetime FROM first_row_n", ["first_row_n"])


def _corr(a: str, b: str) -> str:
    xs = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
    ys = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_samp({xs}, {ys}) / NULLIF(stddev_samp({xs}) * stddev_samp({ys}), 0)"


_pairs = list(combinations_with_replacement(range(len(USER_COLUMNS)), 2))
cte("corr_all", "  SELECT " + ",\n    ".join(f"{_corr(USER_COLUMNS[i], USER_COLUMNS[j])} AS c{i}_{j}" for i, j in _pairs)
    + "\n  FROM utable", ["utable"])
_rows = []
for i, j in _pairs:
    _rows.append(f"SELECT '{USER_COLUMNS[i]}' AS feature_a, '{USER_COLUMNS[j]}' AS feature_b, {r6(f'c{i}_{j}')} AS corr FROM corr_all")
    if i != j:
        _rows.append(f"SELECT '{USER_COLUMNS[j]}', '{USER_COLUMNS[i]}', {r6(f'c{i}_{j}')} FROM corr_all")
query("correlation_matrix", "\nUNION ALL ".join(_rows), ["corr_all"])
_t = len(USER_COLUMNS) - 1
cte("corr_target", "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, c{min(i, _t)}_{max(i, _t)} AS corr FROM corr_all" for i, c in enumerate(USER_COLUMNS)), ["corr_all"])
query("correlation_with_churn", f"SELECT feature, {r6('corr')} AS corr FROM corr_target", ["corr_target"])
query(
    "top_abs_correlations",
    f"""SELECT feature, {r6('corr')} AS corr FROM corr_target WHERE feature <> 'is_churned_user'
ORDER BY abs(corr) DESC NULLS LAST, feature LIMIT 12""",
    ["corr_target"],
)
cte("base_users", "  SELECT DISTINCT userId FROM evn WHERE userId IS NOT NULL", ["evn"])
query("missing_users_check", "SELECT b.userId FROM base_users b ANTI JOIN churn_tsn c ON b.userId = c.userId",
      ["base_users", "churn_tsn"])
query("align_to_users", "SELECT b.userId, t.time_to_churn_days FROM base_users b LEFT JOIN ttc t ON b.userId = t.userId",
      ["base_users", "ttc"])
query(
    "assert_user_table",
    "SELECT count(*) AS rows, (SELECT count(*) FROM base_users) AS base_users, count(*) FILTER (WHERE userId IS NULL) AS null_keys FROM utable",
    ["utable", "base_users"],
)


def histogram_sql(src: str, col: str, n: int) -> str:
    def edge(i: str) -> str:
        return f"CASE WHEN {i} >= {n} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / CAST({n} AS DOUBLE)) + lo END"

    return f"""WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
bnd AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
b0 AS (SELECT x, lo, hi, least(CAST(floor((x - lo) * (CAST({n} AS DOUBLE) / (hi - lo))) AS BIGINT), {n - 1}) AS i0 FROM v, bnd),
b1 AS (SELECT x, lo, hi, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT CASE WHEN x >= {edge('(i1 + 1)')} AND i1 <> {n - 1} THEN i1 + 1 ELSE i1 END AS bin FROM b1),
cnt AS (SELECT bin, count(*) AS c FROM b2 GROUP BY bin)
SELECT CAST(r.i AS BIGINT) AS bin, {r6(edge('r.i'))} AS lo, {r6(edge('(r.i + 1)'))} AS hi, coalesce(cnt.c, 0) AS count
FROM range({n}) r(i) CROSS JOIN bnd LEFT JOIN cnt ON cnt.bin = r.i WHERE bnd.lo IS NOT NULL"""


cte("hs_src", "  SELECT d.session_duration_min FROM evn e LEFT JOIN sess_dur d ON e.sessionId = d.sessionId", ["evn", "sess_dur"])
query("histogram_session_length", histogram_sql("hs_src", "session_duration_min", 50), ["hs_src"])
query("histogram_sessions_per_user", histogram_sql("sess_per_user", "sessions", 50), ["sess_per_user"])
query("histogram_devices_per_user", histogram_sql("dev_per_user", "devices", 20), ["dev_per_user"])
query("histogram_avg_session_hours", histogram_sql("avg_sess_hours", "avg_session_hours", 10), ["avg_sess_hours"])
query("histogram_time_to_churn", histogram_sql("ttc", "time_to_churn_days", 30), ["ttc"])
