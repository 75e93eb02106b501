"""The canonical event DataFrame.

Two ways in: ``load_events`` reads the native JSON-Lines event log with a
declared schema; ``events_from_tables`` derives the same columns from the
benchmark ``events`` + ``nation`` tables (the rules are written identically
in the SQL oracle). Both return:

    event_seq LONG, userId STRING, sessionId LONG, datetime TIMESTAMP_NTZ,
    date DATE, registration_datetime TIMESTAMP_NTZ, page STRING, level STRING,
    gender STRING, length DOUBLE, artist STRING, userAgent STRING,
    location STRING, auth STRING, status INT
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.functions.expr import epoch_millis_to_ntz, normalize_blank

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.StringType()),
        T.StructField("sessionId", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("registration", T.LongType()),
        T.StructField("page", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("artist", T.StringType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("auth", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

CANONICAL_COLUMNS = [
    "event_seq",
    "userId",
    "sessionId",
    "datetime",
    "date",
    "registration_datetime",
    "page",
    "level",
    "gender",
    "length",
    "artist",
    "userAgent",
    "location",
    "auth",
    "status",
]

BLANK_POLICIES = ("keep", "null")


def apply_blank_policy(ev: DataFrame, blank_user: str) -> DataFrame:
    """``keep``: '' is an ordinary user (production loader);
    ``null``: '' becomes null (exploration notebooks)."""
    if blank_user not in BLANK_POLICIES:
        raise ValueError(f"blank_user must be one of {BLANK_POLICIES}")
    if blank_user == "null":
        return ev.withColumn("userId", normalize_blank("userId"))
    return ev


#: Bits of an event's place within its file; the file's number stands above them.
PLACE_BITS, ROW_BITS = 43, 33


def load_events(spark: SparkSession, path: str | list[str], blank_user: str = "keep") -> DataFrame:
    """Read a JSON-Lines event log into the canonical form.

    Epoch-millisecond ``ts``/``registration`` become naive timestamps (null
    where out of range); a missing path is an error (raised by the reader at
    analysis time). Malformed lines are kept with null fields and their text
    in ``_corrupt_record`` (PERMISSIVE mode), see ``corrupt_lines``.

    ``event_seq`` is log order: files by path, lines by place. A line's place
    is the start of its split plus its row number in the task: a task reads
    at most one split's worth of bytes and a line has at least two, so places
    of one split stay below the start of the next. How Spark packs files into
    tasks changes the numbers but never their order within a file."""
    raw = (
        spark.read.schema(EVENT_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = raw.select("*", F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/")).alias("_file"), (F.col("_metadata.file_block_start") + row).alias("_place"))
    # one row per file of the listing that the driver holds anyway
    files = spark.createDataFrame([(f.replace(":///", ":/"), i) for i, f in enumerate(sorted(raw.inputFiles()))], "_file string, _file_no long")
    placed = placed.join(F.broadcast(files), "_file", "left")
    seq = F.shiftleft(F.coalesce(F.col("_file_no"), F.lit(0)), PLACE_BITS) + F.col("_place")
    return canonicalize(placed, seq, blank_user)


def write_event_log(ev: DataFrame, path: str, files: int = 4) -> None:
    """Canonical events as JSON Lines, in log order over at least so many files (as far as there are events),
    and as many range partitions as a shuffle has."""
    millis = lambda c: F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    same = [f.name for f in EVENT_SCHEMA.fields if f.name not in ("ts", "registration", "_corrupt_record")]
    parts = max(files, int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = ev.repartitionByRange(parts, "event_seq").sortWithinPartitions("event_seq")
    lines.select(*same, millis("datetime").alias("ts"), millis("registration_datetime").alias("registration")).write.json(path)


def canonicalize(raw: DataFrame, seq, blank_user: str = "keep") -> DataFrame:
    """Raw JSON fields (``EVENT_SCHEMA``) -> canonical columns; ``seq`` is
    the log-order tiebreak column."""
    ev = raw.select(
        seq.alias("event_seq"),
        "userId",
        "sessionId",
        epoch_millis_to_ntz("ts").alias("datetime"),
        epoch_millis_to_ntz("registration").alias("registration_datetime"),
        "page",
        "level",
        "gender",
        "length",
        "artist",
        "userAgent",
        "location",
        "auth",
        "status",
        "_corrupt_record",
    ).withColumn("date", F.to_date("datetime"))
    ev = apply_blank_policy(ev, blank_user)
    return ev.select(*CANONICAL_COLUMNS, "_corrupt_record")


def canonical(ev: DataFrame) -> DataFrame:
    return ev.select(*CANONICAL_COLUMNS)


# --- fixed values of the test-table adapter -------------------------------
CLICK_PAGES = ["Thumbs Up", "Thumbs Down", "Add to Playlist", "Add Friend", "Home", "Roll Advert"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 6.1) Chrome/36.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X) Safari/537.77",
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/31.0",
    "Mozilla/5.0 (iPhone; CPU OS 7) Safari/9537.53",
    "Opera/12.0 (Android 4.4)",
]  # index 5 -> null
REGISTRATION_ANCHOR = "2024-01-03 12:00:00"
# --- end of fixed values ---------------------------------------------------


def events_from_tables(
    spark: SparkSession, sf_dir: str, blank_user: str = "keep", with_location: bool = True
) -> DataFrame:
    """Canonical events derived from the ``events`` and ``nation`` tables.

    Pure projection of ``events`` plus, when ``with_location``, one lookup
    join to ``nation`` (25 rows, broadcast by Spark's own size check).
    Catalyst cannot drop an unused outer join, so queries that never read
    ``location`` ask for the events without it (the column is then absent,
    not null)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the props text is '{"k": <int>}'; a regular expression reads it several
    # times faster than a JSON parser (same rule as the SQL oracle)
    k = F.nullif(F.regexp_extract("props", r'"k":\s*(\d+)', 1), F.lit("")).cast("int")
    uid = F.col("user_id")
    et = F.col("event_type")
    click_page = F.element_at(F.array(*[F.lit(p) for p in CLICK_PAGES]), (F.col("_k") % 6 + 1).cast("int"))
    page = (
        F.when(et == "view", F.lit("NextSong"))
        .when(et == "click", click_page)
        .when(et == "error", F.when(F.col("_k") % 2 == 0, F.lit("Error")).otherwise(F.lit("Help")))
        .when(et == "signup", F.when(F.col("_k") < 15, F.lit("Submit Upgrade")).otherwise(F.lit("Downgrade")))
        .when(et == "purchase", F.when(F.col("_k") < 12, F.lit("Submit Downgrade")).otherwise(F.lit("NextSong")))
    )
    agent_idx = (uid + F.col("_k") % 2) % 6
    agent = F.element_at(F.array(*[F.lit(a) for a in USER_AGENTS], F.lit(None).cast("string")), (agent_idx + 1).cast("int"))
    gmod = uid % 10
    gender = F.when(gmod <= 4, F.lit("F")).when(gmod <= 8, F.lit("M"))
    registration = F.when(uid % 13 == 12, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.lit(REGISTRATION_ANCHOR).cast("timestamp_ntz") - F.make_dt_interval(days=(uid % 90).cast("int"))
    )
    base = e.select(
        F.col("event_id").alias("event_seq"),
        "user_id",
        F.col("ts").cast("timestamp_ntz").alias("datetime"),
        et.alias("event_type"),
        "value",
        k.alias("_k"),
    )
    staged = base.select(
        "event_seq",
        "user_id",
        F.when(uid % 37 == 36, F.lit("")).otherwise(uid.cast("string")).alias("userId"),
        (uid * 1000 + F.dayofyear("datetime")).cast("long").alias("sessionId"),
        "datetime",
        F.to_date("datetime").alias("date"),
        registration.alias("registration_datetime"),
        page.alias("page"),
        F.when(F.col("event_seq") * 7919 % 10 < 6, F.lit("paid")).otherwise(F.lit("free")).alias("level"),
        gender.alias("gender"),
        "value",
        "_k",
        agent.alias("userAgent"),
        F.lit("Logged In").alias("auth"),
        F.lit(200).alias("status"),
    )
    is_song = F.col("page") == "NextSong"
    ev = staged.select(
        "*",
        F.when(is_song, F.col("value")).alias("length"),
        F.when(is_song, F.concat(F.lit("artist_"), (F.col("_k") % 12).cast("string"))).alias("artist"),
    )
    if not with_location:
        return apply_blank_policy(ev.select(*[c for c in CANONICAL_COLUMNS if c != "location"]), blank_user)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("location")
    )
    ev = ev.join(nation, (F.col("user_id") % 25) == F.col("_nk"), "left")
    return apply_blank_policy(ev.select(*CANONICAL_COLUMNS), blank_user)


def corrupt_lines(ev: DataFrame) -> DataFrame:
    """Lines of a JSON-Lines log that failed to parse, with the fields that
    did parse. Spark refuses a scan that needs the corrupt-record column
    alone, so consume the rows (write / collect) rather than ``count()``
    them, or persist the parsed log first."""
    return ev.filter(F.col("_corrupt_record").isNotNull()).select("event_seq", "userId", "_corrupt_record")
