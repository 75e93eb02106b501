import random

import duckdb
import numpy as np
import pytest

from attrition.llm import divergence
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture
def audit(spark, tmp_path):
    """Rows (text, lang, source) in a table with further columns: the audit and its SQL."""

    def run(rows):
        folder = str(tmp_path / "d.parquet")
        full = [(*r, "x", 1, [2]) for r in rows]
        spark.createDataFrame(full, "text string, lang string, source string, term string, idx int, postings array<int>").repartition(3).write.mode("overwrite").parquet(folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
        got = divergence.audit(spark.read.parquet(folder)).select("lang", "source", "part", "item", "value", "rank").collect()
        return {tuple(r) for r in got}, len(got), set(con.execute(divergence.AUDIT_SQL).fetchall())

    return run


def words(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def table(rng):
    common, rare = ["the", "And", "éa", "x", "的文"], [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for lang in ("en", "de", None):
        for source in ("s0", "s1", "s2", "", None, "empty"):
            for _ in range(30 if source == "s0" else 6):
                text = words(rng, common + rng.sample(rare, 5), rng.randint(0, 40))
                rows.append((None if source == "empty" else text, lang, source))
    rows += [(t, "odd", f"o{i % 3}") for i, t in enumerate(ODD_TEXTS * 4)]
    rows += [("few words here", "fr", "a"), ("few others there", "fr", "b"), (None, None, None), ("alone", "it", "only")]
    return rows


def test_audit_equals_sql(audit):
    got, n, want = audit(table(random.Random(1)))
    assert got == want and n == len(want)
    assert ("fr", "a", "pair", "b", 0, 1) in got
    assert any(r[1] == "" and r[2] == "term" for r in got)


def test_a_source_with_most_rows_and_blocks_of_few_rows(audit, monkeypatch):
    """Blocks of two rows of sums and many slices give the same."""
    rng = random.Random(2)
    rows = [(words(rng, ["a", "b", "c", "d", "e"], 8), "en", "s0" if rng.random() < 0.6 else f"s{rng.randint(1, 12)}") for _ in range(400)]
    monkeypatch.setattr(divergence, "CELLS", 26)
    monkeypatch.setattr(divergence, "TERMS_PER_SLICE", 1)
    monkeypatch.setattr(divergence, "HELD", 7)
    got, n, want = audit(rows)
    assert got == want and n == len(want)


def test_scatter_equals_loops():
    rng = np.random.default_rng(4)
    p0 = rng.integers(1, 1000, 9)
    lists = [np.sort(rng.choice(9, rng.integers(1, 9), replace=False)) for _ in range(50)]
    offsets, peer = np.append(0, np.cumsum([len(x) for x in lists])), np.concatenate(lists)
    p = rng.integers(1, 10**9, len(peer))
    sums, want = np.zeros((4, 9), np.int64), np.zeros((4, 9), np.int64)
    divergence.scatter(offsets, peer, p, p0[peer], sums, 3)

    def f(a, b):
        return (int(a) - int(b)) ** 2 // (int(a) + int(b))

    for t in range(50):
        span = range(offsets[t], offsets[t + 1])
        for i in span:
            if 3 <= peer[i] < 7:
                for j in span:
                    a, b = p0[peer[i]], p0[peer[j]]
                    want[peer[i] - 3, peer[j]] += f(p[i], p[j]) - f(p[i], b) - f(a, p[j]) + f(a, b)
    assert (sums == want).all()


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, kept = 7 * 10**15 + 1, 9 * 10**15 + 7, 12345
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_empty_table(audit):
    got, _, want = audit([("x", "en", "a")])
    assert got == want == set()


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
