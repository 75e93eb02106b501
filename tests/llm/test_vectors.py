import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attrition.llm import components, pigeonhole, vantage
from oracle.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture
def make_vectors(spark, tmp_path):
    import duckdb

    def make(rows, element="float"):
        folder = str(tmp_path / f"v{abs(hash(str(rows[:2]))) % 10**8}")
        spark.createDataFrame([(i, v, None, "x", 1) for i, v in rows], f"vec_id long, embedding array<{element}>, label int, rep string, n int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
        return spark.read.parquet(f"{folder}/embeddings.parquet"), con

    return make


def clustered(n=160, length=20, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, length))
    rows = []
    for i in range(n):
        v = centres[i % 12] + rng.standard_normal(length) * rng.choice([0.02, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.5, 1, 7])]))
    rows += [(n + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(n + 40 + i, [2 * x for x in rows[5][1]]) for i in range(3)]  # same direction, other length
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * length, [nan] + [1.0] * (length - 1), [inf] * length, [None] + [1.0] * (length - 1)]
    return rows + [(n + 60 + i, v) for i, v in enumerate(odd)]


def test_pigeonhole_equals_brute_force(make_vectors):
    vectors, con = make_vectors(clustered())
    for tile in (4096, 16):
        r = compare(pigeonhole.near_duplicates(vectors, tile=tile), con, pigeonhole.DUPLICATES_SQL)
        assert r["values_match"], r


def test_pigeonhole_with_doubles_repeated_ids_and_other_lengths(make_vectors):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0]
    vectors, _ = make_vectors([(1, a), (1, a), (2, b), (None, a), (3, [1.0, 0.0]), (4, [1.0])], "double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pigeonhole.near_duplicates(vectors).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
    assert pigeonhole.near_duplicates(vectors.limit(0)).collect() == []


def test_memory_of_a_tile_does_not_grow_with_the_pairs_of_a_group():
    """Two groups of distinct near copies, with 4.5 million pairs of 16 bytes each way, and a few that stand alone."""
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(8)[:2], 1500, axis=0) + rng.standard_normal((3000, 8)) * 1e-3
    x = np.concatenate([x, np.eye(8)[2:]])
    rep, n = rng.permutation(len(x)) + 100, rng.integers(1, 4, len(x))
    both = pd.DataFrame({"home": np.repeat([True, False], len(x)), "rep": np.tile(rep, 2), "n": np.tile(n, 2), "vector": [v.tobytes() for v in x] * 2})
    tracemalloc.start()
    out = pigeonhole._tiles("<f8", 0.9)((8, 0, 0, 0, 0), both)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    group = [slice(0, 1500), slice(1500, 3000)]
    want = {int(r): (int(rep[g].min()), int(n[g].sum() - k)) for g in group for r, k in zip(rep[g], n[g], strict=True)}
    assert {r: (o, k) for r, o, k in zip(out.rep.tolist(), out.other.tolist(), out.n_links.tolist(), strict=True)} == want
    assert peak < 64 << 20, peak


def test_every_near_pair_is_within_the_budget_of_some_part():
    rng = np.random.default_rng(0)
    for length in (3, 8, 20, 64, 100):
        x = rng.standard_normal((300, length))
        y = x + rng.standard_normal((300, length)) * 0.3 * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(length)
        (x, tx), (y, ty) = (pigeonhole.unit_and_turned(v) for v in (x, y))
        near = (x * y).sum(1) >= 0.9
        assert (pigeonhole.unit_and_turned(x[7:8])[1] == pigeonhole.unit_and_turned(x)[1][7:8]).all()
        parts = pigeonhole.parts(length)
        within = np.stack([((tx[:, s] - ty[:, s]) ** 2).sum(1) for s in parts], 1) <= pigeonhole.budgets(length, 0.9)
        assert near.any() and within[near].any(1).all()


def test_two_vectors_meet_once_and_few_copies_are_sent():
    """Over all cells and parts each linked pair comes from one place; a vector goes only to cells that aren't before its own."""
    rng = np.random.default_rng(9)
    n, length = 600, 64
    x = np.repeat(rng.standard_normal((60, length)), 10, axis=0) + rng.standard_normal((n, length)) * 0.2
    rep = rng.permutation(n) + 5
    batch = pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.ones(n, np.int64)), pa.array(x.tolist())], names=["rep", "n", "embedding"])
    sent = pa.Table.from_batches(list(pigeonhole._cells("<f8", 0.9)([batch]))).to_pandas()
    met = []
    for (_, part, _), g in sent.groupby(["length", "part", "cell"]):
        if g.home.nunique() < 2:
            continue
        h, c = ((s.rep.to_numpy(), pigeonhole.matrix(s.vector, "<f8")) for s in (g[g.home], g[~g.home]))
        met += [(h[0][a], c[0][b]) for i, j in pigeonhole.join_tile(int(part), 0.9, h, c) for a, b in zip(i, j, strict=True)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert len(i) and sorted(tuple(sorted(p)) for p in met) == sorted(tuple(sorted(p)) for p in zip(rep[i], rep[j], strict=True))
    assert len(sent) <= 20 * n


def test_vantage_search_equals_brute_force(make_vectors):
    vectors, con = make_vectors(clustered(seed=5))
    for shard_rows in (64, 9, 1000):
        r = compare(vantage.search(vectors, F.col("vec_id") % 20 == 0, shard_rows=shard_rows), con, vantage.SEARCH_SQL)
        assert r["values_match"], r


def test_vantage_search_of_several_lengths_and_unusable_vectors_of_an_id(make_vectors):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(3 + i % 2).tolist()) for i in range(90)]
    vectors, con = make_vectors(rows + [(20, [0.0, 0.0, 0.0]), (40, None), (3, [float("nan")] * 3)], "double")
    sql = vantage.SEARCH_SQL.replace("vec_id % 20 = 0", "vec_id % 20 = 0 AND len(q.e) = len(c.e)").replace("q.vec_id <> c.vec_id", "q.vec_id <> c.vec_id AND len(q.e) = len(c.e)")
    for shard_rows in (8, 1000):
        r = compare(vantage.search(vectors, F.col("vec_id") % 20 == 0, k=7, shard_rows=shard_rows), con, sql.replace("rank <= 20", "rank <= 7"))
        assert r["values_match"] and r["spark_rows"] == 35, r


def test_a_query_skips_cells_that_its_bound_closes():
    """Far clusters: a query is open to few cells, and its best points all lie in those."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 6)) * 10
    x = centres[np.arange(2000) % 40] + rng.standard_normal((2000, 6)) * 0.05
    c = vantage.Cells(np.zeros((0, 7)), float((x**2).sum(1).max()))
    c.points = c.raised(x[:40])
    d = c.distances(c.raised(x))
    cell = d.argmin(1)
    own = d[np.arange(2000), cell]
    c.shards, c.lo, c.hi = np.ones(40, int), *(np.array([f(own[cell == i]) for i in range(40)]) for f in (min, max))
    score = np.sort(x[::20] @ x.T, axis=1)[:, -20]
    open_ = c.open(x[::20], score, 1.0)
    for i, q in enumerate(x[::20]):
        assert open_[i, cell[x @ q >= score[i]]].all()
    assert open_.mean() < 0.5
    assert c.open(x[::20], np.full(100, -np.inf), 1.0).all()


def test_vantage_ties_small_tables_and_empty(make_vectors):
    vectors, con = make_vectors([(i, [1.0, float(i % 2)]) for i in range(45)] + [(None, [1.0, 1.0]), (0, [1.0, 0.0])])
    r = compare(vantage.search(vectors, F.col("vec_id") % 20 == 0, shard_rows=10), con, "SELECT * FROM (" + vantage.SEARCH_SQL.replace("FROM embeddings", "FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL)") + ")")
    assert r["values_match"], r
    few, _ = make_vectors([(0, [1.0, 2.0]), (7, [3.0, 4.0])])
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in vantage.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 11.0)]
    assert vantage.search(few.limit(0), F.col("vec_id") == 0).collect() == []


def brute(x, q, q_ids, k):
    s = q @ x.T
    s[np.arange(len(q)), q_ids] = -np.inf
    return np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("unit,factor,least", [(False, 1.0, 1.0), (True, 1.0, 1.0), (True, 0.5, 0.95), (False, 0.8, 0.9)])
def test_recall_by_factor(unit, factor, least):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 8)) * 4
    x = centres[rng.integers(60, size=4000)] + rng.standard_normal((4000, 8)) * 0.5
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    q_ids = np.arange(0, 4000, 20)
    r, p, _ = vantage.nearest(x, np.arange(4000), x[q_ids], q_ids, 20, factor)
    want = brute(x, x[q_ids].copy(), q_ids, 20)
    assert sum(len(set(p[r == i]) & set(want[i])) for i in range(len(q_ids))) / want.size >= least


def test_a_smaller_factor_looks_at_fewer_points(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))[rng.integers(60, size=3000)] + rng.standard_normal((3000, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen, squared = [0], vantage.Search.squared
    monkeypatch.setattr(vantage.Search, "squared", lambda self, rows, points: (seen.__setitem__(0, seen[0] + len(rows) * len(points)), squared(self, rows, points))[1])
    looked = []
    for factor in (1.0, 0.6, 0.3):
        seen[0] = 0
        vantage.nearest(x, np.arange(3000), x[::20], np.arange(0, 3000, 20), 20, factor)
        looked.append(seen[0])
    assert looked[0] > looked[1] > looked[2] and looked[0] < 3000 * 150


def test_memory_of_a_search_does_not_hold_the_vectors_of_all_ties():
    """450,000 ties of 64 dimensions, 230 MB a side."""
    x = np.ones((1500, 64))
    q_ids = np.arange(0, 1500, 5)
    tracemalloc.start()
    r, p, score = vantage.nearest(x, np.arange(1500), x[q_ids], q_ids, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [[v for v in range(21) if v != i][:20] for i in q_ids]
    assert r.tolist() == np.repeat(np.arange(300), 20).tolist() and p.reshape(300, 20).tolist() == want and (score == 64).all()
    assert peak < 128 << 20, peak


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (None, 4), (5, None), (-9, 500), (500, 501), (501, -9)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {k: 100 for k in range(100, 161)} | {k: 7 for k in range(7, 40)} | {-9: -9, 500: -9, 501: -9}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_queries_match_sql_on_the_small_table(spark):
    from attrition.llm import catalog

    con = duck(SF)
    for name, sql in catalog.oracle_queries().items():
        r = compare(catalog.queries()[name](spark, SF), con, sql)
        assert r["columns_match"] and r["values_match"], (name, r)


def test_components_start_no_second_set_of_tasks(spark):
    """Pairs and their reverse come from one pass; a union reads them twice, in as many tasks again."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 85), (70, 70)], "a long, b long")
    out = components.components(edges)
    assert dict(out.collect()) == {i: 0 for i in range(41)} | {i: 80 for i in (80, 85, 90)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
