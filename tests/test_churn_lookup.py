"""Churn by candidates: the same rows as the numbered log, few records shuffled."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.functions.keyset import in_key_set, key_set
from attrition.operators import churn as C
from attrition.sources.events import events_from_tables, load_events
from oracle.compare import compare, duck
from oracle.sql import oracle_queries
from tests.conftest import BASE_MS, HOUR, SF_ORACLE, event


def shuffled_records(frame):
    """Records each exchange of an executed frame wrote."""
    written, stack = [], [frame._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name, children = node.nodeName(), node.children()
        if name == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(node.plan())
        stack += [children.apply(i) for i in range(children.size())]
    return written


def plain_churn(lines):
    """Positions of churn lines by a loop over each user's sorted lines."""
    out = []
    for user in {r["userId"] for r in lines if r["userId"] is not None}:
        mine = sorted(((r["ts"] is None, r["ts"] or 0, i) for i, r in enumerate(lines) if r["userId"] == user))
        levels = [lines[i]["level"] for *_, i in mine]
        out += [
            i for k, (*_, i) in enumerate(mine)
            if lines[i]["page"] == "Submit Downgrade" and 0 < k < len(mine) - 1 and levels[k - 1] == "paid" and levels[k + 1] == "free"
        ]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_candidates_equal_a_loop(spark, jsonl, seed):
    """Ties, null times, null levels, null users, gaps of days, a user with half the log."""
    r = random.Random(seed)
    lines = [
        event(r.choice(["hot", "hot", "hot", "a", "b", "", None]),
              None if r.random() < 0.1 else BASE_MS + r.choice([0, 1, 5, 30, 700]) * HOUR + r.randrange(6) * 1000,
              page=r.choice(["Submit Downgrade", "NextSong", "Home"]), level=r.choice(["paid", "paid", "free", "free", "trial", None]), artist=f"line {i}")
        for i in range(250)
    ]
    ev = load_events(spark, jsonl(lines))
    got = C.churn_candidates(ev.select(*C.ORDER_INPUT, "page", "level", "artist")).collect()
    assert sorted(int(x.artist.split()[1]) for x in got) == plain_churn(lines)
    assert len(plain_churn(lines)) > 3


@pytest.mark.parametrize("name, find", [("churn_events", C.churn_events), ("churn_timestamps", C.churn_timestamps)])
def test_both_ways_equal_the_oracle(spark, name, find):
    ev = events_from_tables(spark, SF_ORACLE, "keep")
    for limit in (0, 2**60):
        r = compare(find(ev, limit), duck(SF_ORACLE), oracle_queries()[name])
        assert r["columns_match"] and r["values_match"] and r["spark_rows"] == r["oracle_rows"] > 0, (limit, r)


def test_no_events_and_no_candidates(spark, jsonl):
    ev = load_events(spark, jsonl([event("1", BASE_MS), event("1", BASE_MS + 1)]))
    assert C.churn_timestamps(ev, 0).collect() == [] and C.churn_events(ev.limit(0), 0).collect() == []


def test_neighbours_may_be_far_away(spark, jsonl):
    days = 24 * HOUR
    lines = [event("1", BASE_MS, level="paid"), event("1", BASE_MS + 50 * days, page="Submit Downgrade"), event("1", BASE_MS + 90 * days, level="free"),
             event("2", BASE_MS, page="Submit Downgrade"), event("2", BASE_MS + 5, level="free")]
    found = C.churn_events(load_events(spark, jsonl(lines)), 0).collect()
    assert [(x.userId, x.prev_level, x.next_level) for x in found] == [("1", "paid", "free")]


@pytest.mark.parametrize("every, share", [(1000, 0.1), (100, 0.5)])
def test_few_records_are_shuffled(spark, tmp_path, every, share):
    """Users with fifteen events an hour: under a tenth of a record an event with a candidate
    in a thousand events, under half of one with a candidate in a hundred."""
    n, users = 200_000, 100
    pick = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m))
    hours = n / users / 15
    time = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * F.lit(hours * 3600 / n)).cast("decimal(18,6)"))
    log = spark.range(0, n, 1, 4).select(
        F.col("id").alias("event_seq"), pick(1, users).cast("string").alias("userId"), time.alias("datetime"),
        F.when(pick(2, every) == 0, "Submit Downgrade").otherwise("NextSong").alias("page"), F.when(pick(3, 2) == 0, "paid").otherwise("free").alias("level"),
    )
    log.write.parquet(f"{tmp_path}/log")
    frame = C.churn_candidates(spark.read.parquet(f"{tmp_path}/log"))
    found = sorted(r.event_seq for r in frame.collect())
    assert sum(shuffled_records(frame)) < share * n
    w = Window.partitionBy("userId").orderBy("datetime", "event_seq")
    want = log.withColumns({"p": F.lag("level").over(w), "f": F.lead("level").over(w)}).where("page = 'Submit Downgrade' and p = 'paid' and f = 'free'")
    assert found == sorted(r.event_seq for r in want.collect()) and found


def test_key_set_keeps_every_wanted_key(spark):
    x = spark.range(20_000).select(F.col("id"), (F.col("id") % 977).cast("string").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("g"))
    wanted = x.where("id % 977 < 40 and id < 977")
    for bits, most in ((27, 1.01), (8, 60)):  # a small set keeps more, never less
        marks = key_set(wanted, ["k"], bits)
        kept = in_key_set(x, ["k"], marks, bits)
        exact = x.join(wanted.select("k").distinct(), "k", "left_semi")
        assert exact.exceptAll(kept.select(exact.columns)).count() == 0
        assert kept.count() <= most * exact.count() and marks.count() <= max(2 ** (bits - 6), 1)
    assert in_key_set(x, ["g"], key_set(x.where("g is null"), ["g"])).where("g is null").count() == 4000
