"""Incremental ingest of the append-only JSON-Lines event log.

The batch jobs read the whole log. When new log files keep arriving, this
reads the log folder as a Structured Streaming file source with the same
declared schema and canonical columns, and adds each micro-batch to a
Parquet table. The batch queries then read that table. No streaming analytics
are added: the original program has none.

Events are numbered as the batch loader does: by file, start of the split in
it, and row of the task. Files get their numbers when they arrive, those of one
micro-batch by path, and keep them in ``<table>_files``; so a log whose files
arrive in the order of their paths has the same order of events either way,
lines that repeat each other included. A micro-batch that is run again after a
failure overwrites its own part of the table and finds its files' numbers there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.session import Storage
from attrition.sources.events import EVENT_SCHEMA, PLACE_BITS, ROW_BITS, canonicalize

FILES_SCHEMA = "batch_id long, _file string, _file_no long"


def read_event_stream(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of raw log lines with the file and split they come from."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(log_dir).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def add_batch(lines: DataFrame, batch_id: int, table_path: str, blank_user: str = "keep") -> None:
    """Numbers a micro-batch's files and lines and writes its part of the table."""
    spark = lines.sparkSession
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = lines.withColumn("_place", F.col("_start") + row)
    numbers = f"{table_path}_files"
    if not Storage(spark, numbers).written(f"{numbers}/batch={batch_id}"):
        known = spark.read.schema(FILES_SCHEMA).option("recursiveFileLookup", "true").parquet(numbers) if Storage(spark, numbers).exists(numbers) else spark.createDataFrame([], FILES_SCHEMA)
        known = known.where(F.col("batch_id") != batch_id)
        before = known.select(F.coalesce(F.max("_file_no") + 1, F.lit(0))).first()[0]
        # one row for each file of the micro-batch
        new = lines.select("_file").distinct().withColumn("_file_no", F.row_number().over(Window.orderBy("_file")) - 1 + before)
        new.select(F.lit(batch_id).cast("long").alias("batch_id"), "_file", F.col("_file_no").cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{numbers}/batch={batch_id}")
    files = spark.read.schema(FILES_SCHEMA).parquet(f"{numbers}/batch={batch_id}").drop("batch_id")
    seq = F.shiftleft("_file_no", PLACE_BITS) + F.col("_place")
    out = canonicalize(placed.join(files, "_file"), seq, blank_user)
    out.write.mode("overwrite").partitionBy("date").parquet(f"{table_path}/batch={batch_id}")


def ingest_events(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = True, blank_user: str = "keep"):
    """Adds what arrives to a Parquet table partitioned by micro-batch and ``date``
    (partition pruning for date-bounded reads). Returns the started query;
    ``available_now`` processes what is there and stops."""
    writer = stream.writeStream.foreachBatch(lambda lines, batch_id: add_batch(lines, batch_id, table_path, blank_user)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
