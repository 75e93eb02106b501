"""Distinct counts by merged bit sets against plain Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from attrition.config import PAGES
from attrition.functions.bitset import bit_sets, count_sets, known_bit, merge_sets
from attrition.operators import users as U
from attrition.sources.events import load_events
from tests.conftest import BASE_MS, HOUR, event

TEXTS = ["17", "017", "+17", " 17", "17 ", "-0", "0", "-1", "1.0", "", "x", "9223372036854775807", "9223372036854775808", None]


def test_texts_and_integers_counted_like_a_set(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice(TEXTS), rng.choice([None, 0, -1, -64, 63, 64, 2**63 - 1, -(2**63), rng.randrange(300)])) for _ in range(3000)]
    rows += [(9, None, None)]  # a group of nulls only counts 0
    df = spark.createDataFrame(rows, "g int, t string, i long").repartition(5)
    for place, name in ((1, "t"), (2, "i")):
        want = {g: len({r[place] for r in rows if r[0] == g and r[place] is not None}) for g in {r[0] for r in rows}}
        assert {r["g"]: r["n"] for r in count_sets(bit_sets(df, ["g"], name), ["g"], "n").collect()} == want


def test_sets_of_days_merge_to_a_week_without_the_events(spark):
    rng = random.Random(4)
    rows = [(d, str(rng.randrange(200)) if d % 3 else f"u{rng.randrange(20)}") for d in range(21) for _ in range(80)]
    days = bit_sets(spark.createDataFrame(rows, "d int, u string"), ["d"], "u").withColumn("w", F.expr("d div 7"))
    got = {r["w"]: r["n"] for r in count_sets(merge_sets(days, ["w"]), ["w"], "n").collect()}
    assert got == {w: len({u for d, u in rows if d // 7 == w}) for w in range(3)}


def test_neighbouring_ids_share_rows_and_few_ids_have_few(spark):
    df = spark.range(6400).select(F.lit(1).alias("g"), "id")
    assert bit_sets(df, ["g"], "id").count() == 100
    assert bit_sets(df.filter("id % 640 = 0"), ["g"], "id").count() == 10


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, t string")
    assert count_sets(bit_sets(df, ["g"], "t"), ["g"], "n").collect() == []


def test_known_bit_takes_at_most_63_texts(spark):
    with pytest.raises(ValueError):
        known_bit("page", [str(i) for i in range(64)])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_user_table_counts_distincts_without_expand(spark, jsonl):
    rng = random.Random(5)
    pages = PAGES + ["Elsewhere", "Elsewhere too", None]
    rows = [
        dict(u=rng.choice(["1", "2", "hot", "hot", "hot"]), page=rng.choice(pages), sessionId=rng.choice([None, *range(1, 400, 7)]), userAgent=rng.choice([None, "A", "B", "C"]))
        for _ in range(600)
    ]
    rows += [dict(u="none", page=None, sessionId=None, userAgent=None)]
    path = jsonl([event(r["u"], BASE_MS + i * HOUR // 7, page=r["page"], sessionId=r["sessionId"], userAgent=r["userAgent"]) for i, r in enumerate(rows)])
    table = U.user_features(load_events(spark, path))
    assert "Expand" not in _plan(table)
    got = {r["userId"]: (r["total_sessions"], r["unique_pages"], r["unique_user_agents"]) for r in table.collect()}
    want = {}
    for u in {r["u"] for r in rows}:
        want[u] = tuple(float(len({r[c] for r in rows if r["u"] == u and r[c] is not None})) for c in ("sessionId", "page", "userAgent"))
    assert got == want
