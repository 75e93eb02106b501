"""Oracle SQL for the user-day feature table and its parts.

Deliberately the straightforward formulation: a generated calendar spine
per user, left-joined to daily counts, entropy and user dimensions - an
independent check of the join-free Spark plan.
"""

from __future__ import annotations

from oracle.sql import ORDER, cte, query, r6, safe_div

PAGES = ["NextSong", "Thumbs Up", "Thumbs Down", "Add to Playlist", "Add Friend", "Help", "Error",
         "Downgrade", "Submit Downgrade", "Home", "Roll Advert"]
CORE = ["events", "listen_sec"] + PAGES
S, L, H = 7, 14, 5
FEATURES = [
    "days_since_join", "gender_code", "day_of_month", "day_of_week", "dow_sin", "dow_cos", "dom_sin", "dom_cos",
    "artist_entropy_day", "cum_events", "cum_listen_sec", "cum_NextSong", "cum_Thumbs Up", "cum_Thumbs Down",
    "cum_Add to Playlist", "cum_Add Friend", "win7_events", "win7_listen_sec", "win7_NextSong", "win7_Thumbs Up",
    "win7_Thumbs Down", "win7_Add to Playlist", "win7_Add Friend", "ratio_thumbs_up", "ratio_playlist",
    "ratio_friend", "ratio7_thumbs_up", "ratio7_playlist", "ratio7_friend", "chg_thumbs_up", "chg_playlist",
    "chg_friend", "win7_error_rate", "win7_help_rate", "downgrade_wo_submit", "prop_nextsong", "win14_events",
    "win14_listen_sec", "win14_NextSong", "win14_Thumbs Up", "win14_Thumbs Down", "win14_Add to Playlist",
    "win14_Add Friend", "ratio14_thumbs_up", "ratio14_playlist", "ratio14_friend", "delta7_14_thumbs",
    "delta7_14_playlist",
]
LABEL = "label_churn_horizon"


def q(c: str) -> str:
    return f'"{c}"'


def dbl(cols: list[str], src: str = "") -> str:
    p = f"{src}." if src else ""
    return ", ".join(f"{r6(p + q(c))} AS {q(c)}" for c in cols)


cte(
    "daily",
    "  SELECT userId, date, count(*) AS events, coalesce(sum(length), 0.0) AS listen_sec, "
    + ", ".join(f"count(*) FILTER (WHERE page = '{p}') AS {q(p)}" for p in PAGES)
    + "\n  FROM ev WHERE userId IS NOT NULL AND date IS NOT NULL GROUP BY userId, date",
    ["ev"],
)
cte(
    "art",
    """  SELECT userId, date, artist, count(*) AS cnt FROM ev
  WHERE userId IS NOT NULL AND date IS NOT NULL AND artist IS NOT NULL GROUP BY userId, date, artist""",
    ["ev"],
)
cte(
    "ent",
    """  SELECT userId, date, -sum(p * log2(p)) AS artist_entropy_day
  FROM (SELECT userId, date, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY userId, date) AS p FROM art) shares
  GROUP BY userId, date""",
    ["art"],
)
cte(
    "first_row_k",
    f"""  SELECT userId, gender, registration_datetime FROM (
    SELECT userId, gender, registration_datetime, row_number() OVER (PARTITION BY userId ORDER BY {ORDER}) AS r
    FROM ev WHERE userId IS NOT NULL) WHERE r = 1""",
    ["ev"],
)
cte(
    "udims",
    "  SELECT userId, min(registration_datetime) AS reg FROM ev WHERE userId IS NOT NULL GROUP BY userId",
    ["ev"],
)
cte(
    "spine",
    """  SELECT userId, CAST(unnest(generate_series(CAST(first_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT b.userId, b.first_date, least(b.last_date, coalesce(c.churn_date, b.last_date)) AS end_date
        FROM (SELECT userId, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY userId) b
        LEFT JOIN churn_tsk c ON b.userId = c.userId) x""",
    ["daily", "churn_tsk"],
)
cte(
    "dense",
    "  SELECT s.userId, s.date, "
    + ", ".join(f"coalesce(d.{q(c)}, 0) AS {q(c)}" for c in CORE)
    + """, coalesce(e.artist_entropy_day, 0.0) AS artist_entropy_day,
         u.reg, f.gender, c.churn_ts, c.churn_date
  FROM spine s
  LEFT JOIN daily d ON s.userId = d.userId AND s.date = d.date
  LEFT JOIN ent e ON s.userId = e.userId AND s.date = e.date
  LEFT JOIN udims u ON s.userId = u.userId
  LEFT JOIN first_row_k f ON s.userId = f.userId
  LEFT JOIN churn_tsk c ON s.userId = c.userId""",
    ["spine", "daily", "ent", "udims", "first_row_k", "churn_tsk"],
)
def feature_ctes(prefix: str, dense: str) -> str:
    """Register ``<prefix>wsums`` / ``<prefix>feat1`` / ``<prefix>feat`` on a
    dense user-day CTE; returns the name of the final one."""
    sums = []
    for c in CORE:
        sums.append(f"CAST(sum({q(c)}) OVER wc AS DOUBLE) AS {q('cum_' + c)}")
        sums.append(f"CAST(sum({q(c)}) OVER ws AS DOUBLE) AS {q(f'win{S}_' + c)}")
        sums.append(f"CAST(sum({q(c)}) OVER wl AS DOUBLE) AS {q(f'win{L}_' + c)}")
    cte(
        f"{prefix}wsums",
        "  SELECT *, " + ",\n    ".join(sums) + f"""
  FROM {dense}
  WINDOW wc AS (PARTITION BY userId ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ws AS (PARTITION BY userId ORDER BY date ROWS BETWEEN {S - 1} PRECEDING AND CURRENT ROW),
         wl AS (PARTITION BY userId ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)""",
        [dense],
    )
    cte(
        f"{prefix}feat1",
        f"""  SELECT *, day(date) AS day_of_month, isodow(date) AS day_of_week,
    coalesce(date_diff('day', CAST(reg AS DATE), date), 0) AS days_since_join,
    CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS gender_code,
    sin(2 * pi() * CAST(isodow(date) AS DOUBLE) / CAST(7 AS DOUBLE)) AS dow_sin,
    cos(2 * pi() * CAST(isodow(date) AS DOUBLE) / CAST(7 AS DOUBLE)) AS dow_cos,
    sin(2 * pi() * CAST(day(date) AS DOUBLE) / CAST(31 AS DOUBLE)) AS dom_sin,
    cos(2 * pi() * CAST(day(date) AS DOUBLE) / CAST(31 AS DOUBLE)) AS dom_cos,
    {ratio('cum_Thumbs Up', 'cum_NextSong')} AS ratio_thumbs_up,
    {ratio('cum_Add to Playlist', 'cum_NextSong')} AS ratio_playlist,
    {ratio('cum_Add Friend', 'cum_NextSong')} AS ratio_friend,
    {ratio(f'win{S}_Thumbs Up', f'win{S}_NextSong')} AS ratio{S}_thumbs_up,
    {ratio(f'win{S}_Add to Playlist', f'win{S}_NextSong')} AS ratio{S}_playlist,
    {ratio(f'win{S}_Add Friend', f'win{S}_NextSong')} AS ratio{S}_friend,
    {ratio(f'win{L}_Thumbs Up', f'win{L}_NextSong')} AS ratio{L}_thumbs_up,
    {ratio(f'win{L}_Add to Playlist', f'win{L}_NextSong')} AS ratio{L}_playlist,
    {ratio(f'win{L}_Add Friend', f'win{L}_NextSong')} AS ratio{L}_friend,
    {ratio(f'win{S}_Error', f'win{S}_events')} AS win{S}_error_rate,
    {ratio(f'win{S}_Help', f'win{S}_events')} AS win{S}_help_rate,
    CAST("cum_Downgrade" > 0 AND "cum_Submit Downgrade" = 0 AS INTEGER) AS downgrade_wo_submit,
    {ratio('cum_NextSong', 'cum_events')} AS prop_nextsong
  FROM {prefix}wsums""",
        [f"{prefix}wsums"],
    )
    cte(
        f"{prefix}feat",
        f"""  SELECT *,
    ratio{S}_thumbs_up - ratio_thumbs_up AS chg_thumbs_up,
    ratio{S}_playlist - ratio_playlist AS chg_playlist,
    ratio{S}_friend - ratio_friend AS chg_friend,
    ratio{S}_thumbs_up - ratio{L}_thumbs_up AS delta{S}_{L}_thumbs,
    ratio{S}_playlist - ratio{L}_playlist AS delta{S}_{L}_playlist,
    CASE WHEN churn_date IS NOT NULL AND churn_date > date AND churn_date <= date + {H} THEN 1 ELSE 0 END AS {LABEL}
  FROM {prefix}feat1 WHERE churn_date IS NULL OR date <= churn_date""",
        [f"{prefix}feat1"],
    )
    return f"{prefix}feat"


def ratio(a: str, b: str) -> str:
    return safe_div(q(a), q(b))


feature_ctes("", "dense")

K = "userId, date"
query("daily_events", f"SELECT {K}, events FROM daily", ["daily"])
query("daily_listen", f"SELECT {K}, {r6('listen_sec')} AS listen_sec FROM daily", ["daily"])
query("daily_pages", f"SELECT {K}, " + ", ".join(q(p) for p in PAGES) + " FROM daily", ["daily"])
query("daily_assemble", f"SELECT {K}, events, {r6('listen_sec')} AS listen_sec, " + ", ".join(q(p) for p in PAGES) + " FROM daily", ["daily"])
query(
    "user_activity_bounds",
    "SELECT userId, min(date) AS first_date, max(date) AS last_date FROM ev WHERE userId IS NOT NULL AND date IS NOT NULL GROUP BY userId",
    ["ev"],
)
query("artist_entropy", f"SELECT {K}, {r6('artist_entropy_day')} AS artist_entropy_day FROM ent", ["ent"])
query(
    "share_of_day",
    f"SELECT {K}, artist, cnt, {r6('CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY userId, date)')} AS p FROM art",
    ["art"],
)
query(
    "daily_spine",
    f"SELECT {K}, events, {r6('listen_sec')} AS listen_sec, " + ", ".join(q(p) for p in PAGES) + " FROM dense",
    ["dense"],
)
query("attach_entropy", f"SELECT {K}, {r6('artist_entropy_day')} AS artist_entropy_day FROM dense", ["dense"])
query(
    "attach_user_dims",
    f"""SELECT {K}, churn_ts, churn_date, reg AS registration_datetime,
       CAST(CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS BIGINT) AS gender_code FROM dense""",
    ["dense"],
)
query(
    "gender_code",
    "SELECT userId, CAST(CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS BIGINT) AS gender_code FROM first_row_k",
    ["first_row_k"],
)
query("safe_div", f"SELECT {K}, {r6(safe_div(q('Thumbs Up'), q('NextSong')))} AS thumbs_up_per_song FROM daily", ["daily"])


def _sel(name: str, cols: list[str]) -> None:
    query(name, f"SELECT {K}, {dbl(cols)} FROM feat", ["feat"])


_sel("cumulative_features", [f"cum_{c}" for c in CORE])
_sel("rolling_features", [f"win{S}_{c}" for c in CORE] + [f"win{L}_{c}" for c in CORE])
_sel("days_since_join", ["days_since_join"])
_sel("cyclical_encode", ["day_of_week", "day_of_month", "dow_sin", "dow_cos", "dom_sin", "dom_cos"])
_sel("ratio_features", ["ratio_thumbs_up", "ratio_playlist", "ratio_friend", f"ratio{S}_thumbs_up", f"ratio{S}_playlist",
                        f"ratio{S}_friend", f"ratio{L}_thumbs_up", f"ratio{L}_playlist", f"ratio{L}_friend"])
_sel("change_features", ["chg_thumbs_up", "chg_playlist", "chg_friend", f"delta{S}_{L}_thumbs", f"delta{S}_{L}_playlist"])
_sel("intensity_features", [f"win{S}_error_rate", f"win{S}_help_rate"])
_sel("downgrade_wo_submit", ["downgrade_wo_submit"])
_sel("prop_nextsong", ["prop_nextsong"])
query("label_horizon", f"SELECT {K}, churn_date, CAST({LABEL} AS BIGINT) AS {LABEL} FROM feat", ["feat"])
cte("matrix", f"  SELECT {K}, {dbl(FEATURES)}, CAST({LABEL} AS BIGINT) AS {LABEL} FROM feat", ["feat"])
query("user_day_features", "SELECT * FROM matrix", ["matrix"])
query("clean_matrix", f"SELECT * EXCLUDE (userId, date) FROM matrix", ["matrix"])
query(
    "reindex_columns",
    f"""SELECT {K}, events, "NextSong", "Thumbs Up", CAST(0.0 AS DOUBLE) AS "Submit Upgrade", {r6('listen_sec')} AS listen_sec
FROM dense""",
    ["dense"],
)
query(
    "class_balance",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {LABEL} = 1) AS positives,
       {r6(f'CAST(count(*) FILTER (WHERE {LABEL} = 1) AS DOUBLE) / count(*)')} AS pos_rate,
       {r6(f'(1.0 - CAST(count(*) FILTER (WHERE {LABEL} = 1) AS DOUBLE) / count(*)) / greatest(CAST(count(*) FILTER (WHERE {LABEL} = 1) AS DOUBLE) / count(*), 1e-9)')} AS scale_pos_weight
FROM matrix""",
    ["matrix"],
)

# --- as-of features for requests derived from the log ------------------------
cte(
    "req",
    """  SELECT CASE k WHEN 2 THEN 'no such user ' || userId ELSE userId END AS user_id,
         CAST(CASE k WHEN 1 THEN first_date - 1 ELSE first_date + CAST(floor(date_diff('day', first_date, last_date) / 2) AS INTEGER) END AS TIMESTAMP)
           + INTERVAL 12 HOUR AS date
  FROM (SELECT userId, min(date) AS first_date, max(date) AS last_date FROM ev
        WHERE userId IS NOT NULL AND date IS NOT NULL GROUP BY userId) b, (SELECT unnest([0, 1, 2]) AS k) ks""",
    ["ev"],
)
query(
    "filter_user_asof",
    """SELECT r.user_id, r.date, CASE WHEN e.userId IS NOT NULL THEN 'ok' WHEN r.user_id IN (SELECT userId FROM ev WHERE userId IS NOT NULL) THEN 'no_activity'
       ELSE 'unknown_user' END AS status, e.event_seq, e.datetime
FROM req r LEFT JOIN ev e ON e.userId = r.user_id AND e.date <= CAST(r.date AS DATE)""",
    ["req", "ev"],
)
cte("req_end", "  SELECT user_id AS userId, max(CAST(date AS DATE)) AS end_date FROM req GROUP BY user_id", ["req"])
cte(
    "aday",
    """  SELECT userId, date, min(registration_datetime) AS reg_day,
         min({'s': event_seq, 'g': gender}) AS first_day
  FROM ev WHERE userId IS NOT NULL AND date IS NOT NULL GROUP BY userId, date""",
    ["ev"],
)
cte(
    "aspine",
    """  SELECT userId, CAST(unnest(generate_series(CAST(first_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT d.userId, min(d.date) AS first_date, e.end_date FROM daily d JOIN req_end e ON d.userId = e.userId
        WHERE d.date <= e.end_date GROUP BY d.userId, e.end_date) x""",
    ["daily", "req_end"],
)
cte(
    "adense",
    "  SELECT s.userId, s.date, "
    + ", ".join(f"coalesce(d.{q(c)}, 0) AS {q(c)}" for c in CORE)
    + """, coalesce(e.artist_entropy_day, 0.0) AS artist_entropy_day,
         min(a.reg_day) OVER run AS reg, (min(a.first_day) OVER run).g AS gender,
         CAST(NULL AS TIMESTAMP) AS churn_ts, CAST(NULL AS DATE) AS churn_date
  FROM aspine s
  LEFT JOIN daily d ON s.userId = d.userId AND s.date = d.date
  LEFT JOIN ent e ON s.userId = e.userId AND s.date = e.date
  LEFT JOIN aday a ON s.userId = a.userId AND s.date = a.date
  WINDOW run AS (PARTITION BY s.userId ORDER BY s.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ["aspine", "daily", "ent", "aday"],
)
feature_ctes("a", "adense")
ASOF = (
    f"""SELECT r.user_id, r.date,
       CASE WHEN k.userId IS NULL THEN 'unknown_user' WHEN f.userId IS NULL THEN 'no_activity' ELSE 'ok' END AS status,
       {dbl(FEATURES, 'f')}
FROM req r
LEFT JOIN afeat f ON f.userId = r.user_id AND f.date = CAST(r.date AS DATE)
LEFT JOIN (SELECT DISTINCT userId FROM ev WHERE userId IS NOT NULL) k ON k.userId = r.user_id""",
    ["req", "afeat", "ev"],
)
query("asof_features", *ASOF)
query("asof_features_stored", *ASOF)
