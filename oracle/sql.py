"""DuckDB SQL texts, one per registered query.

CTEs are registered with their dependencies; ``build`` emits only the CTEs a
query needs, in dependency order. Every floating output is rounded to 6
places (``+ 0.0`` folds -0.0), as the Spark side does.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {}
QUERIES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = (body, deps or [])


def query(name: str, body: str, deps: list[str] | None = None) -> None:
    QUERIES[name] = (body, deps or [])


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def build(name: str) -> str:
    body, deps = QUERIES[name]
    names = _order(deps)
    if not names:
        return body
    withs = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in names)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {withs},\n{body.lstrip()[5:]}"
    return f"WITH {withs}\n{body}"


def oracle_queries() -> dict[str, str]:
    return {name: build(name) for name in QUERIES}


def r6(expr: str) -> str:
    """Round to 6 places the way Spark does for doubles: half-up on the
    shortest decimal string of the value (not on its binary value)."""
    v = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN isfinite({v}) THEN CAST(round(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38,20)), 6) AS DOUBLE) "
            f"ELSE {v} END + 0.0)")


def floor_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def safe_div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


ORDER = "datetime ASC NULLS LAST, event_seq"

# --- adapter over the benchmark tables (same rules as the Spark adapter) ---
cte(
    "ev_base",
    r"""  SELECT event_id AS event_seq, user_id, ts AS datetime, event_type, value,
         CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS INTEGER) AS k
  FROM events""",
)
cte(
    "ev_stage",
    """  SELECT event_seq, user_id,
    CASE WHEN user_id % 37 = 36 THEN '' ELSE CAST(user_id AS VARCHAR) END AS userId,
    CAST(user_id * 1000 + dayofyear(datetime) AS BIGINT) AS sessionId,
    datetime, CAST(datetime AS DATE) AS date,
    CASE WHEN user_id % 13 = 12 THEN NULL
         ELSE TIMESTAMP '2024-01-03 12:00:00' - to_days(CAST(user_id % 90 AS INTEGER)) END AS registration_datetime,
    CASE event_type
      WHEN 'view' THEN 'NextSong'
      WHEN 'click' THEN CASE k % 6 WHEN 0 THEN 'Thumbs Up' WHEN 1 THEN 'Thumbs Down' WHEN 2 THEN 'Add to Playlist'
                                   WHEN 3 THEN 'Add Friend' WHEN 4 THEN 'Home' ELSE 'Roll Advert' END
      WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'Error' ELSE 'Help' END
      WHEN 'signup' THEN CASE WHEN k < 15 THEN 'Submit Upgrade' ELSE 'Downgrade' END
      WHEN 'purchase' THEN CASE WHEN k < 12 THEN 'Submit Downgrade' ELSE 'NextSong' END
    END AS page,
    CASE WHEN (event_seq * 7919) % 10 < 6 THEN 'paid' ELSE 'free' END AS level,
    CASE WHEN user_id % 10 <= 4 THEN 'F' WHEN user_id % 10 <= 8 THEN 'M' END AS gender,
    value, k,
    CASE (user_id + k % 2) % 6
      WHEN 0 THEN 'Mozilla/5.0 (Windows NT 6.1) Chrome/36.0 Safari/537.36'
      WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X) Safari/537.77'
      WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/31.0'
      WHEN 3 THEN 'Mozilla/5.0 (iPhone; CPU OS 7) Safari/9537.53'
      WHEN 4 THEN 'Opera/12.0 (Android 4.4)'
    END AS userAgent
  FROM ev_base""",
    ["ev_base"],
)
cte(
    "ev",
    """  SELECT s.event_seq, s.userId, s.sessionId, s.datetime, s.date, s.registration_datetime,
         s.page, s.level, s.gender,
         CASE WHEN s.page = 'NextSong' THEN s.value END AS length,
         CASE WHEN s.page = 'NextSong' THEN 'artist_' || CAST(s.k % 12 AS VARCHAR) END AS artist,
         s.userAgent, n.n_name AS location, 'Logged In' AS auth, CAST(200 AS INTEGER) AS status
  FROM ev_stage s LEFT JOIN nation n ON n.n_nationkey = s.user_id % 25""",
    ["ev_stage"],
)
cte("evn", "  SELECT * REPLACE (NULLIF(userId, '') AS userId) FROM ev", ["ev"])


def _churn_ctes(sfx: str, src: str) -> None:
    cte(
        f"seq{sfx}",
        f"""  SELECT *, lag(level) OVER w AS prev_level, lead(level) OVER w AS next_level,
         row_number() OVER w AS rn
  FROM {src} WHERE userId IS NOT NULL
  WINDOW w AS (PARTITION BY userId ORDER BY {ORDER})""",
        [src],
    )
    cte(
        f"churn{sfx}",
        f"""  SELECT * FROM seq{sfx}
  WHERE page = 'Submit Downgrade' AND coalesce(prev_level = 'paid', false) AND coalesce(next_level = 'free', false)""",
        [f"seq{sfx}"],
    )
    cte(
        f"churn_ts{sfx}",
        f"  SELECT userId, min(datetime) AS churn_ts, CAST(min(datetime) AS DATE) AS churn_date FROM churn{sfx} GROUP BY userId",
        [f"churn{sfx}"],
    )


_churn_ctes("k", "ev")
_churn_ctes("n", "evn")

# --- sources / scalar projections -------------------------------------------
CANON = ("event_seq, userId, sessionId, datetime, date, registration_datetime, page, level, gender, "
         "length, artist, userAgent, location, auth, status")
# the log holds milliseconds
LOGGED = CANON.replace(" datetime,", " date_trunc('milliseconds', datetime) AS datetime,")
query("load_events", f"SELECT row_number() OVER (ORDER BY event_seq) AS {LOGGED} FROM ev", ["ev"])
query(
    "events_profile",
    """SELECT count(*) AS rows, count(DISTINCT userId) AS unique_users,
       count(*) FILTER (WHERE datetime IS NULL) AS null_timestamps FROM ev""",
    ["ev"],
)
query(
    "enrich_calendar",
    """SELECT event_seq, date, CAST(hour(datetime) AS BIGINT) AS hour, CAST(day(datetime) AS BIGINT) AS day_of_month,
       CAST(isodow(datetime) AS BIGINT) AS day_of_week, dayname(datetime) AS day_name FROM evn""",
    ["evn"],
)
query(
    "days_since_registration",
    f"SELECT event_seq, {floor_days('datetime', 'registration_datetime')} AS days_since_registration FROM evn",
    ["evn"],
)
query(
    "parse_user_agent",
    """SELECT event_seq, userAgent,
       NULLIF(regexp_extract(userAgent, '(Firefox|Chrome|Safari|Edge|MSIE|Opera)', 1), '') AS browser,
       NULLIF(regexp_extract(userAgent, '(Windows|Macintosh|Linux|iPhone|Android)', 1), '') AS os FROM evn""",
    ["evn"],
)
query("normalize_blank", "SELECT event_seq, userId FROM evn", ["evn"])
PAGES_SQL = ("'NextSong', 'Thumbs Up', 'Thumbs Down', 'Add to Playlist', 'Add Friend', 'Help', 'Error', "
             "'Downgrade', 'Submit Downgrade', 'Home', 'Roll Advert'")
query("filter_pages", f"SELECT {CANON} FROM ev WHERE page IN ({PAGES_SQL})", ["ev"])

# --- exploration ------------------------------------------------------------
query("total_unique_users", "SELECT count(DISTINCT userId) AS total_users FROM evn", ["evn"])
query(
    "active_users_per_day",
    "SELECT date, count(DISTINCT userId) AS active_users FROM evn WHERE date IS NOT NULL GROUP BY date",
    ["evn"],
)
query(
    "sessions_per_day",
    "SELECT date, count(DISTINCT sessionId) AS sessions FROM evn WHERE date IS NOT NULL GROUP BY date",
    ["evn"],
)
query(
    "series_pair_join",
    """SELECT date, count(DISTINCT userId) AS active_users, count(DISTINCT sessionId) AS sessions
       FROM evn WHERE date IS NOT NULL GROUP BY date""",
    ["evn"],
)
query(
    "sessions_by_hour",
    """SELECT CAST(hour(datetime) AS BIGINT) AS hour, count(DISTINCT sessionId) AS sessions
       FROM evn WHERE datetime IS NOT NULL GROUP BY 1""",
    ["evn"],
)
cte(
    "sess_dur",
    """  SELECT sessionId, (epoch_us(max(datetime)) - epoch_us(min(datetime))) / 60000000.0 AS session_duration_min
  FROM evn WHERE sessionId IS NOT NULL GROUP BY sessionId""",
    ["evn"],
)
query("session_durations", f"SELECT sessionId, {r6('session_duration_min')} AS session_duration_min FROM sess_dur", ["sess_dur"])
query(
    "session_duration_join",
    f"""SELECT e.event_seq, e.userId, e.sessionId, e.datetime, e.date, e.registration_datetime, e.page, e.level, e.gender,
       {r6('e.length')} AS length, e.artist, e.userAgent, e.location, e.auth, e.status,
       {r6('d.session_duration_min')} AS session_duration_min
FROM evn e LEFT JOIN sess_dur d ON e.sessionId = d.sessionId""",
    ["evn", "sess_dur"],
)
query("events_by_gender", "SELECT gender, count(*) AS events FROM evn GROUP BY gender", ["evn"])
query(
    "users_by_gender",
    "SELECT gender, count(DISTINCT userId) AS users FROM evn WHERE gender IS NOT NULL GROUP BY gender",
    ["evn"],
)
query("page_counts", "SELECT page, count(*) AS events FROM evn WHERE page IS NOT NULL GROUP BY page", ["evn"])
cte(
    "page_level",
    """  SELECT page, count(*) FILTER (WHERE level = 'free') AS free, count(*) FILTER (WHERE level = 'paid') AS paid
  FROM evn WHERE page IS NOT NULL AND level IN ('free', 'paid') GROUP BY page""",
    ["evn"],
)
query("page_by_level", "SELECT page, free, paid, free + paid AS total FROM page_level", ["page_level"])
query(
    "page_by_level_pct",
    f"""SELECT page, {r6('CAST(free AS DOUBLE) / (free + paid) * 100.0')} AS free_pct,
       {r6('CAST(paid AS DOUBLE) / (free + paid) * 100.0')} AS paid_pct FROM page_level""",
    ["page_level"],
)
cte(
    "sess_per_user",
    "  SELECT userId, count(DISTINCT sessionId) AS sessions FROM evn WHERE userId IS NOT NULL GROUP BY userId",
    ["evn"],
)
query("sessions_per_user", "SELECT * FROM sess_per_user", ["sess_per_user"])
cte(
    "dev_per_user",
    "  SELECT userId, count(DISTINCT userAgent) AS devices FROM evn WHERE userId IS NOT NULL GROUP BY userId",
    ["evn"],
)
query("devices_per_user", "SELECT * FROM dev_per_user", ["dev_per_user"])
cte(
    "avg_sess_hours",
    """  SELECT e.userId, CAST(floor(avg(d.session_duration_min) / 60.0) AS DOUBLE) AS avg_session_hours
  FROM evn e LEFT JOIN sess_dur d ON e.sessionId = d.sessionId WHERE e.userId IS NOT NULL GROUP BY e.userId""",
    ["evn", "sess_dur"],
)
query("avg_session_hours_per_user", f"SELECT userId, {r6('avg_session_hours')} AS avg_session_hours FROM avg_sess_hours", ["avg_sess_hours"])
query(
    "top_locations",
    """SELECT location, count(*) AS events FROM evn WHERE location IS NOT NULL GROUP BY location
       ORDER BY events DESC, location ASC LIMIT 10""",
    ["evn"],
)
query(
    "top_users",
    """SELECT userId, count(*) AS events FROM evn WHERE userId IS NOT NULL GROUP BY userId
       ORDER BY events DESC, userId ASC LIMIT 10""",
    ["evn"],
)

# --- churn ------------------------------------------------------------------
query(
    "level_neighbours",
    "SELECT event_seq, userId, datetime, level, prev_level, next_level FROM seqk",
    ["seqk"],
)
query(
    "churn_events",
    f"""SELECT event_seq, datetime, userId, sessionId, page, level, prev_level, next_level, auth, status, location, gender
       FROM churnk""",
    ["churnk"],
)
query("churn_timestamps", "SELECT userId, churn_ts, churn_date FROM churn_tsk", ["churn_tsk"])
query(
    "churn_summary",
    f"""SELECT count(*) AS churn_events, count(DISTINCT userId) AS churned_users,
       (SELECT count(DISTINCT userId) FROM evn) AS total_users,
       {r6('CAST(count(DISTINCT userId) AS DOUBLE) / NULLIF((SELECT count(DISTINCT userId) FROM evn), 0)')} AS churned_share
FROM churnn""",
    ["churnn", "evn"],
)
query(
    "assert_churn_meaning",
    """SELECT count(*) AS churn_events,
       count(*) FILTER (WHERE prev_level IS NULL OR next_level IS NULL OR prev_level <> 'paid' OR next_level <> 'free') AS violations
FROM churnn""",
    ["churnn"],
)
query(
    "flag_churned_users",
    f"""SELECT e.event_seq, e.userId, (c.userId IS NOT NULL) AS is_churned_user
FROM evn e LEFT JOIN churn_tsn c ON e.userId = c.userId""",
    ["evn", "churn_tsn"],
)
cte(
    "ttc",
    f"""  SELECT c.userId, {floor_days('c.churn_ts', 'f.first_activity')} AS time_to_churn_days
  FROM churn_tsn c JOIN (SELECT userId, min(datetime) AS first_activity FROM evn WHERE userId IS NOT NULL GROUP BY userId) f
    ON c.userId = f.userId""",
    ["churn_tsn", "evn"],
)
query("time_to_churn", "SELECT * FROM ttc", ["ttc"])
query(
    "time_to_churn_stats",
    f"""SELECT {r6('median(time_to_churn_days)')} AS median_days, {r6('avg(time_to_churn_days)')} AS mean_days,
       min(time_to_churn_days) AS min_days, max(time_to_churn_days) AS max_days FROM ttc""",
    ["ttc"],
)
cte(
    "resub",
    f"""  SELECT c.userId,
         min(CASE WHEN e.datetime < c.churn_ts THEN e.datetime END) AS first_subscribe,
         c.churn_ts AS churn_date,
         min(CASE WHEN e.datetime > c.churn_ts THEN e.datetime END) AS first_resubscribe
  FROM churn_tsn c JOIN evn e ON e.userId = c.userId AND e.page = 'Submit Upgrade'
  GROUP BY c.userId, c.churn_ts
  HAVING min(CASE WHEN e.datetime > c.churn_ts THEN e.datetime END) IS NOT NULL""",
    ["churn_tsn", "evn"],
)
query(
    "resubscribe",
    f"""SELECT userId, first_subscribe, churn_date, first_resubscribe,
       {floor_days('first_resubscribe', 'churn_date')} AS days_between_churn_and_resubscribe FROM resub""",
    ["resub"],
)
query(
    "resubscribe_summary",
    "SELECT count(DISTINCT userId) AS unique_users_resubscribed, count(*) AS total_resubscribe_events FROM resub",
    ["resub"],
)
cte(
    "active_day",
    "  SELECT CAST(datetime AS DATE) AS date, count(DISTINCT userId) AS active_users FROM evn WHERE datetime IS NOT NULL GROUP BY 1",
    ["evn"],
)
cte("churn_day", "  SELECT churn_date AS date, count(*) AS churned_users FROM churn_tsn GROUP BY 1", ["churn_tsn"])
RATE = "coalesce(CAST(c.churned_users AS DOUBLE) / NULLIF(a.active_users, 0) * 100.0, 0.0)"
query(
    "daily_churn_rate",
    f"""SELECT a.date, a.active_users, coalesce(c.churned_users, 0) AS churned_users, {r6(RATE)} AS churn_rate
FROM active_day a LEFT JOIN churn_day c ON a.date = c.date""",
    ["active_day", "churn_day"],
)
query(
    "daily_churn_rate_churn_days",
    f"""SELECT a.date, a.active_users, coalesce(c.churned_users, 0) AS churned_users, {r6(RATE)} AS churn_rate
FROM active_day a JOIN churn_day c ON a.date = c.date""",
    ["active_day", "churn_day"],
)
query(
    "churn_rate_by_dom",
    f"""SELECT CAST(coalesce(a.dom, c.dom) AS BIGINT) AS day_of_month, {r6(RATE)} AS churn_rate
FROM (SELECT day(datetime) AS dom, count(DISTINCT userId) AS active_users FROM evn WHERE datetime IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT day(churn_ts) AS dom, count(*) AS churned_users FROM churn_tsn GROUP BY 1) c ON a.dom = c.dom""",
    ["evn", "churn_tsn"],
)
query(
    "churn_rate_by_dow",
    f"""SELECT d.day_of_week, d.day_name, {r6(RATE)} AS churn_rate
FROM (SELECT CAST(i AS BIGINT) AS day_of_week,
             ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][i] AS day_name
      FROM range(1, 8) t(i)) d
LEFT JOIN (SELECT isodow(datetime) AS dow, count(DISTINCT userId) AS active_users FROM evn WHERE datetime IS NOT NULL GROUP BY 1) a
  ON d.day_of_week = a.dow
LEFT JOIN (SELECT isodow(churn_ts) AS dow, count(*) AS churned_users FROM churn_tsn GROUP BY 1) c ON d.day_of_week = c.dow""",
    ["evn", "churn_tsn"],
)
cte(
    "first_row_n",
    f"""  SELECT userId, gender, registration_datetime FROM (
    SELECT userId, gender, registration_datetime, row_number() OVER (PARTITION BY userId ORDER BY {ORDER}) AS r
    FROM evn WHERE userId IS NOT NULL) WHERE r = 1""",
    ["evn"],
)
query(
    "churn_by_gender",
    """SELECT f.gender, count(*) FILTER (WHERE c.userId IS NULL) AS not_churned, count(*) FILTER (WHERE c.userId IS NOT NULL) AS churned
FROM first_row_n f LEFT JOIN churn_tsn c ON f.userId = c.userId WHERE f.gender IS NOT NULL GROUP BY f.gender""",
    ["first_row_n", "churn_tsn"],
)
query(
    "churn_context",
    """WITH picked AS (
  SELECT userId AS u, rn AS crn, datetime AS churn_at, event_seq AS cseq,
         row_number() OVER (ORDER BY userId, datetime ASC NULLS LAST, event_seq) AS churn_no
  FROM churnn ORDER BY userId, datetime ASC NULLS LAST, event_seq LIMIT 3)
SELECT CAST(p.churn_no AS BIGINT) AS churn_no, s.userId, p.churn_at, s.event_seq, s.datetime, s.page, s.level,
       s.sessionId, s.status, s.auth, (s.event_seq = p.cseq) AS is_churn_row
FROM seqn s JOIN picked p ON s.userId = p.u AND s.rn BETWEEN p.crn - 5 AND p.crn + 5""",
    ["churnn", "seqn"],
)
query(
    "session_timeline",
    f"""WITH top AS (
  SELECT userId, row_number() OVER (ORDER BY events DESC, userId) - 1 AS user_rank FROM (
    SELECT userId, count(*) AS events FROM evn WHERE userId IS NOT NULL GROUP BY userId
    ORDER BY events DESC, userId LIMIT 10) t),
sub AS (SELECT e.*, t.user_rank FROM evn e JOIN top t ON e.userId = t.userId),
sess AS (SELECT sessionId, (row_number() OVER (ORDER BY min(datetime) ASC NULLS LAST, arg_min(event_seq, datetime)) - 1) % 20 AS color
         FROM sub GROUP BY sessionId)
SELECT s.userId, CAST(s.user_rank AS BIGINT) AS user_rank, s.event_seq, s.datetime, s.sessionId, CAST(x.color AS BIGINT) AS session_color
FROM sub s JOIN sess x ON s.sessionId = x.sessionId""",
    ["evn"],
)
