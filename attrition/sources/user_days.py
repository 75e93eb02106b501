"""User-days kept between scoring runs, so that a later batch of requests reads
the asked users and days instead of the event log.

Layout: ``<folder>/buckets=<n>/batch=<name>/date=<day>/bucket=<b>/*.parquet``, a row
per active user-day (``plans.features.daily_table``). A batch holds whole days; events
without a time make rows with a null date, which only tell that a user is known. A
batch is written beside its place and renamed into it last, so a job that dies leaves
nothing half written that is read. The same batch may be appended again (if the job dies
while it replaces the old one, once more)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.config import CORE_COLUMNS
from attrition.session import Storage

BUCKETS = 16
KEYS = ("date", "bucket")
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null


def bucket_of(user: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def _dates(store: Storage, path: str) -> set[str]:
    return {n.removeprefix("date=") for n in store.names(path) if n.startswith("date=")} - {NO_DATE}


def batches(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> list[str]:
    """Names of the whole batches of a store."""
    root = f"{folder.rstrip('/')}/buckets={buckets}"
    store = Storage(spark, root)
    return [n.removeprefix("batch=") for n in store.names(root) if n.startswith("batch=") and store.written(f"{root}/{n}")]


def append_user_days(ev: DataFrame, folder: str, batch: str, buckets: int = BUCKETS) -> None:
    """Stores the user-days of ``ev``, all events of some days, as ``batch`` (in place
    of an older batch of that name). A day that another batch holds is refused: its
    events would be counted in two places."""
    from attrition.plans.features import daily_table

    spark, root = ev.sparkSession, f"{folder.rstrip('/')}/buckets={buckets}"
    store, place, new = Storage(spark, root), f"{root}/batch={batch}", f"{root}/_new-{uuid.uuid4().hex}"
    days = daily_table(ev).withColumn("bucket", bucket_of("userId", buckets))
    days.repartition(*KEYS).sortWithinPartitions(*KEYS, "userId").write.partitionBy(*KEYS).parquet(new)
    taken = {d for b in batches(spark, folder, buckets) if b != batch for d in _dates(store, f"{root}/batch={b}")}
    if twice := sorted(taken & _dates(store, new)):
        store.delete(new)
        raise ValueError(f"days held by another batch: {', '.join(twice)}")
    if store.exists(place):
        store.delete(place)
    store.rename(new, place)


def _schema() -> T.StructType:
    counts = [T.StructField(c, T.DoubleType() if c == "listen_sec" else T.LongType()) for c in CORE_COLUMNS]
    own = T.StructType.fromDDL(
        "userId string, artist_entropy_day double, _reg_day timestamp_ntz, _first_by_time decimal(38,0), _first_by_seq decimal(38,0), "
        "batch string, date date, bucket int"
    )
    return T.StructType(own.fields[:1] + counts + own.fields[1:])


def read_user_days(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """The user-days of all whole batches, with ``bucket``, a partition column like ``date``."""
    root = f"{folder.rstrip('/')}/buckets={buckets}"
    names = batches(spark, folder, buckets)
    if not names:
        raise ValueError(f"no user-days in {buckets} buckets in {folder}")
    paths = [f"{root}/batch={b}" for b in names]
    return spark.read.schema(_schema()).option("basePath", root).parquet(*paths).drop("batch")
