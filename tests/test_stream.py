from attrition.sources.events import CANONICAL_COLUMNS, load_events
from attrition.streaming.events_stream import add_batch, ingest_events, read_event_stream
from tests.conftest import BASE_MS, HOUR, event

COLUMNS = [c for c in CANONICAL_COLUMNS if c != "event_seq"]


def ordered(frame):
    rows = sorted(frame.select("event_seq", *COLUMNS).collect(), key=lambda r: r.event_seq)
    assert len({r.event_seq for r in rows}) == len(rows)
    return [tuple(r)[1:] for r in rows]


def test_stream_ingest_equals_batch_loader_with_repeated_lines(spark, jsonl, tmp_path):
    log, table = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()

    def add(name, rows):
        (log / name).write_text(open(jsonl(rows)).read())

    def run():
        ingest_events(read_event_stream(spark, str(log), max_files_per_trigger=1), table, str(tmp_path / "ckpt")).awaitTermination(120)

    same = event("1", BASE_MS, level="free")
    add("part1.json", [same, event("1", BASE_MS, level="paid"), same, event("", BASE_MS + HOUR), same, event("2", None)])
    add("part2.json", [same, "not json", same])
    run()
    assert ordered(spark.read.parquet(table)) == ordered(load_events(spark, str(log)))
    # further files are picked up incrementally, the earlier ones are not read again
    add("part3.json", [event("3", BASE_MS + 3 * HOUR), same])
    run()
    got = spark.read.parquet(table)
    assert got.count() == 11 and ordered(got) == ordered(load_events(spark, str(log)))
    assert [r.n for r in got.groupBy("batch").count().withColumnRenamed("count", "n").orderBy("batch").collect()] == [6, 3, 2]


def test_a_batch_that_is_run_again_changes_nothing(spark, jsonl, tmp_path):
    from pyspark.sql import functions as F

    from attrition.sources.events import EVENT_SCHEMA

    path, table = jsonl([event("1", BASE_MS), event("2", BASE_MS), event("1", BASE_MS)]), str(tmp_path / "table")
    lines = spark.read.schema(EVENT_SCHEMA).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    add_batch(lines, 0, table)
    first = ordered(spark.read.parquet(table))
    add_batch(lines, 0, table)
    assert ordered(spark.read.parquet(table)) == first and len(first) == 3
