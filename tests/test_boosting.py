"""Boosting kernels and jobs against plain loops."""

import math
import os

import numpy as np
import pytest
from pyspark import BarrierTaskContext

from attrition.config import Params
from attrition.operators import boosting as K
from attrition.plans import boost
from attrition.session import checkpoint_dir, run_dir
from attrition.sources import bundle as B

FEATURES = ["a", "b c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(700):
        x = [float(rng.integers(0, 6)), float(rng.normal()), None if rng.random() < 0.2 else float(rng.random()), 0.0]
        odds = x[0] + 2 * x[1] + 3 * (x[2] or 0) - 4
        rows.append((i, int(rng.random() < 1 / (1 + math.exp(-odds))), "train" if rng.random() < 0.7 else "validation", *x))
    df = spark.createDataFrame(rows, "id long, y int, split string, a double, `b c` double, d double, e double").repartition(5)
    return df.checkpoint() if checkpoint_dir(spark) else df


def fitted(table, params, folder):
    return boost.train_gbt(table, FEATURES, "y", 3.0, params, str(folder), ("id",))


P = Params(rounds=12, max_depth=3, learning_rate=0.3, max_bins=32, seed=7)


def by_loops(table, bins, p, spw):
    """Boosting by loops over rows, nodes, features and cuts; losses after each round."""
    rows = table.selectExpr("xxhash64(id) AS key", "y", "split", *[f"coalesce(`{f}`, 0D) AS f{i}" for i, f in enumerate(FEATURES)]).collect()
    x = np.array([[r[f"f{i}"] for i in range(4)] for r in rows])
    y, train = np.array([r.y for r in rows]), np.array([r.split == "train" for r in rows])
    keys = np.array([r.key for r in rows], np.int64)
    scale, margin, losses = K.fixed_point(int(train.sum()), spw), np.zeros(len(y)), []
    for r in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, spw, 1.0)
        g = [round(v) for v in (w * (prob - y) * scale).tolist()]
        h = [round(v) for v in (w * prob * (1 - prob) * scale).tolist()]
        use = train & K.sampled_rows(keys, r, p)
        columns = K.sampled_features(4, r, p)

        def score(rows_):
            a, b = sum(g[i] for i in rows_), sum(h[i] for i in rows_)
            return (a / scale) ** 2 / (b / scale + p.reg_lambda), b / scale, -p.learning_rate * (a / scale) / (b / scale + p.reg_lambda)

        def down(rows_, all_, depth):
            mine, _, value = score(rows_)
            best = (max(p.gamma, 1e-6), None)
            for f in columns if depth < p.max_depth else ():
                for cut in bins.cuts[f]:
                    sides = [i for i in rows_ if x[i, f] <= cut], [i for i in rows_ if x[i, f] > cut]
                    (sl, hl, _), (sr, hr, _) = map(score, sides)
                    if min(hl, hr) >= p.min_child_weight and sl + sr - mine > best[0]:
                        best = (sl + sr - mine, (f, cut, sides))
            if best[1] is None:
                margin[all_] += value
                return
            f, cut, sides = best[1]
            for side, keep in zip(sides, (x[all_, f] <= cut, x[all_, f] > cut), strict=True):
                down(side, all_[keep], depth + 1)

        down(np.flatnonzero(use).tolist(), np.arange(len(y)), 0)
        losses.append(tuple(float(np.logaddexp(0, np.where(y[s] == 1, -margin[s], margin[s])).mean()) for s in (train, ~train)))
    return losses


def same(a, b):
    return len(a) == len(b) and all((getattr(s, c) == getattr(t, c)).all() for s, t in zip(a, b, strict=True) for c in ("feature", "bin", "cut", "left", "value"))


def test_losses_equal_loops(table, tmp_path):
    model = fitted(table, P, tmp_path)
    bins = boost.feature_cuts(table.where("split = 'train'"), FEATURES, P.max_bins)
    want = by_loops(table, bins, P, 3.0)
    assert len(model.trees) == 12
    assert np.abs(np.array(model.losses) - np.array(want)).max() < 1e-6
    assert want[-1][0] < want[0][0] < math.log(2)
    assert {f: g > 0 for f, g in model.importances()} == {"a": True, "b c": True, "d": True, "e": False}


def test_levels_as_jobs_give_the_same_trees(table, tmp_path, monkeypatch):
    one = fitted(table, P, tmp_path / "one")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boost, "ROUNDS_PER_STATE", 5)
    many = fitted(table, P, tmp_path / "many")
    assert same(one.trees, many.trees)
    assert np.abs(np.array(one.losses) - np.array(many.losses)).max() < 1e-6


@pytest.mark.parametrize("rows_per_task", [50_000, 100])
def test_a_killed_fit_goes_on(table, tmp_path, monkeypatch, rows_per_task):
    monkeypatch.setattr(boost, "ROUNDS_PER_JOB", 4)
    monkeypatch.setattr(boost, "ROUNDS_PER_STATE", 4)
    whole = fitted(table, P, tmp_path / "whole")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", rows_per_task)
    name = "rounds_in_a_task" if rows_per_task > 1000 else "rounds_by_level"
    run, starts = getattr(boost, name), []

    def killed(blocks, fit, before, stop):
        starts.append(stop)
        if len(starts) == 3:
            raise KeyboardInterrupt
        return run(blocks, fit, before, stop)

    monkeypatch.setattr(boost, name, killed)
    with pytest.raises(KeyboardInterrupt):
        fitted(table, P, tmp_path / "killed")
    model = fitted(table, P, tmp_path / "killed")
    assert starts == [4, 8, 12, 12] and same(model.trees, whole.trees) and len(model.losses) == 12
    other = fitted(table, Params(**{**P.__dict__, "rounds": 2}), tmp_path / "killed")  # other parameters: another fit
    assert same(other.trees, whole.trees[:2])


def test_scores_equal_row_by_row_descent(spark, table, tmp_path):
    model = fitted(table, P, tmp_path)
    odd = spark.createDataFrame([(float("nan"), None, 1e9, -1e9), (float("inf"), float("-inf"), 0.0, None)], "a double, `b c` double, d double, e double")
    rows = boost.predict_proba(model, table.select(*[f"`{f}`" for f in FEATURES]).unionByName(odd)).collect()
    for r in rows:
        x = [0.0 if r[f] is None or r[f] != r[f] else r[f] for f in FEATURES]
        margin = 0.0
        for t in model.trees:
            n = 0
            while t.feature[n] >= 0:
                n = t.left[n] + (x[t.feature[n]] > t.cut[n])
            margin += t.value[n]
        assert abs(r.probability - 1 / (1 + math.exp(-margin))) < 1e-12


def test_a_model_too_large_is_refused(table, tmp_path, monkeypatch):
    monkeypatch.setattr(boost, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        boost.predict_proba(fitted(table, Params(rounds=1), tmp_path), table)


def test_no_rows_and_one_class(table, tmp_path):
    none = fitted(table.limit(0), P, tmp_path)
    assert none.trees == [] and {r.probability for r in boost.predict_proba(none, table).collect()} == {0.5}
    one = fitted(table.where("y = 0 AND split = 'train'"), Params(rounds=3), tmp_path)
    assert all(b is None for _, b in one.losses) and max(r.probability for r in boost.predict_proba(one, table).collect()) < 0.5


def test_a_torn_bundle_is_refused_by_name(spark, table, tmp_path):
    model = fitted(table, P, tmp_path / "fit")
    for part in ("nodes", "threshold", "features"):
        path = str(tmp_path / part)
        B.save_model_bundle(spark, path, model, 0.25, FEATURES)
        back = B.load_model_bundle(spark, path)
        assert same(back.model.trees, model.trees) and back.threshold == 0.25 and back.features == FEATURES
        file = next(f for f in os.listdir(f"{path}/{part}") if f.startswith("part-"))
        os.remove(f"{path}/{part}/.{file}.crc")
        with open(f"{path}/{part}/{file}", "r+b") as f:
            f.truncate(os.path.getsize(f"{path}/{part}/{file}") // 2)
        with pytest.raises(ValueError, match=part):
            B.load_model_bundle(spark, path)
    os.rename(f"{path}/manifest", f"{path}/manifest-draft")
    with pytest.raises(FileNotFoundError, match="manifest"):
        B.load_model_bundle(spark, path)


def test_run_folders(spark):
    assert run_dir(spark, "x", "/shared/mine/") == "/shared/mine"
    assert run_dir(spark, "x").startswith(checkpoint_dir(spark)) and run_dir(spark, "x") != run_dir(spark, "x")



@pytest.mark.parametrize("direct", [1, 16])
def test_histograms_sent_or_added_up_by_spark(table, tmp_path, monkeypatch, direct):
    one = fitted(table, Params(**{**P.__dict__, "rounds": 3}), tmp_path / "one")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boost, "DIRECT_TASKS", direct)
    many = fitted(table, Params(**{**P.__dict__, "rounds": 3}), tmp_path / "many")
    assert same(one.trees, many.trees)
    assert np.abs(np.array(one.losses) - np.array(many.losses)).max() < 1e-6


def test_nodes_too_light_for_two_leaves_are_not_summed():
    """Left: a Hessian of 3, too little for two leaves of 2; right: 9, enough."""
    bins, asked = K.Bins([np.array([0.0, 1.0])]), []

    def sums(tree, open_):
        asked.append(list(open_))
        return np.array([[-30, 20, 20]] * len(open_)), np.array([[30, 50, 40]] * len(open_))

    tree = K.grow(sums, bins, np.array([0]), Params(max_depth=2, min_child_weight=2.0), 10.0)
    assert tree.left[0] == 1 and asked == [[0], [2]]


def jobs_of(spark, name, run):
    """Result of a function and the number of Spark jobs that it ran."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_rounds_are_no_more_jobs(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    fit = lambda n: fitted(table, Params(**{**P.__dict__, "rounds": n}), tmp_path / str(n))
    few, a = jobs_of(spark, f"few-{tmp_path}", lambda: fit(2))
    many, b = jobs_of(spark, f"many-{tmp_path}", lambda: fit(12))
    assert same(many.trees[:2], few.trees) and len(many.trees) == 12 and 0 < b <= a + 2


@pytest.mark.parametrize("tasks", [2, 3, 5])
def test_tasks_that_meet_grow_the_trees_of_one_task_and_of_jobs(table, tmp_path, monkeypatch, tasks):
    one = fitted(table, P, tmp_path / "one")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boost, "MOST_TOGETHER", tasks)
    met = fitted(table, P, tmp_path / "met")
    monkeypatch.setattr(boost, "MOST_TOGETHER", 1)
    jobs = fitted(table, P, tmp_path / "jobs")
    for other in (met, jobs):
        assert same(one.trees, other.trees)
        assert np.abs(np.array(one.losses) - np.array(other.losses)).max() < 1e-6
    left = [name for d, dirs, files in os.walk(tmp_path / "met") if os.path.basename(os.path.dirname(d)) == "meet" or os.path.basename(d) == "meet" for name in dirs + files]
    assert not left, left


class Failing(boost.Fit):
    """Task 2 fails once, in its fourth round."""

    def losses(self, blocks):
        self.calls = getattr(self, "calls", 0) + 1
        lost = self.meet.removeprefix("file:") + "-lost"
        if self.calls == 4 and BarrierTaskContext.get().partitionId() == 2 and not os.path.exists(lost):
            open(lost, "w").close()
            raise RuntimeError("lost")
        return super().losses(blocks)


def test_a_lost_task_runs_the_stage_again(table, tmp_path, monkeypatch):
    one = fitted(table, P, tmp_path / "one")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boost, "Fit", Failing)
    again = fitted(table, P, tmp_path / "again")
    assert list((tmp_path / "again").glob("*/meet-lost")) and same(one.trees, again.trees)
    assert np.abs(np.array(one.losses) - np.array(again.losses)).max() < 1e-6


def test_no_barrier_stage_without_slots_or_storage(spark, tmp_path, monkeypatch):
    storage, ask = boost.Storage(spark, str(tmp_path)), lambda rows, tasks: boost.together(spark, rows, tasks, storage, str(tmp_path / "meet"))
    slots = spark.sparkContext.defaultParallelism
    assert ask(1000, slots + 100)[0] == (min(slots, boost.MOST_TOGETHER) if slots > 1 else 0)
    assert ask(1000, 1)[0] == 0 and ask(10**12, 8)[0] == 0
    assert not boost.reachable("viewfs://store/in") and not boost.reachable(f"file://{tmp_path}/missing")
    monkeypatch.setattr(boost, "reachable", lambda folder: False)
    assert ask(1000, 8) == (0, "")


def test_shared_codes_give_the_plain_sums():
    """Features that follow from others, rare combinations that a look at few rows misses, and one of 256 bins."""
    rng = np.random.default_rng(3)
    n = 20_000
    a, wide = rng.integers(0, 7, n), rng.integers(0, 256, n)
    rare = np.where(rng.random(n) < 0.02, rng.integers(0, 200, n), 0)
    columns = np.stack([a, a % 3, wide, rare, rng.integers(0, 4, n), (a + 1) % 7, np.roll(rare, 1)]).astype(np.uint8)
    table = K.Bins([np.arange(c.max()) for c in columns])
    packed = K.Packed(columns, table)
    assert sorted(f for members, *_ in packed.groups for f in members) == list(range(7))
    assert len(packed.groups) < 7 and max(n for _, _, n, *_ in packed.groups) <= 256
    slot, g, h = rng.integers(-1, 3, n), rng.integers(-(2**38), 2**38, n).astype(float), rng.integers(0, 2**38, n).astype(float)
    for asked in (np.arange(7), np.array([1, 2, 6])):
        there = np.isin(table.feature, asked)
        for got, want in zip(packed.histogram(slot, g, h, asked, 3), K.histogram(columns, slot, g, h, table, asked, 3), strict=True):
            assert (got[:, there] == want[:, there]).all()
    assert K.Packed(columns[:, :0], table).histogram(slot[:0], g[:0], h[:0], np.arange(7), 2)[0].sum() == 0


def test_tasks_that_meet_leave_their_margins(table, tmp_path, monkeypatch):
    one = fitted(table, P, tmp_path / "one")
    monkeypatch.setattr(boost, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(boost, "ROUNDS_PER_STATE", 5)
    monkeypatch.setattr(boost, "with_margins", None)  # trees aren't replayed
    assert same(one.trees, fitted(table, P, tmp_path / "met").trees)


def test_cuts_share_one_list_of_literals(table, monkeypatch):
    calls, lit = [], boost.F.lit
    monkeypatch.setattr(boost.F, "lit", lambda x: calls.append(x) or lit(x))
    bins = boost.feature_cuts(table, FEATURES, 32)
    assert sum(x in [i / 32 for i in range(1, 32)] for x in calls if isinstance(x, float)) == 31
    assert [len(c) for c in bins.cuts][0] == 6 and len(bins.cuts[3]) == 1


def test_small_tables_of_the_driver_start_no_python(spark, tmp_path):
    df = B.local_rows(spark, [(1, "a", None, 2), (2, None, 0.5, 3)], "n int, a b string, x double, y long")
    assert df.dtypes == [("n", "int"), ("a b", "string"), ("x", "double"), ("y", "bigint")]
    assert [tuple(r) for r in df.collect()] == [(1, "a", None, 2), (2, None, 0.5, 3)]
    for made in (df, B.save_run_metadata(spark, str(tmp_path / "m"), {"a": 1}), B.bundle_table(spark, B.Bundle(None, 0.5, ["f", "g"]))):
        assert "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()


def test_a_fit_key_ignores_the_last_digits(spark):
    rows = [(i, i % 2, "train", x) for i, x in enumerate([0.1 + 0.2, -0.0, None, 5e8, float(2**60)])]
    keys = []
    for shift in (0.0, 1e-13, 0.01):
        df = spark.createDataFrame([(i, y, s, x if x is None else x + shift) for i, y, s, x in rows], "id long, y int, split string, a double")
        keys.append(boost.fit_key(df, ["a"], "y", 1.0, P, ("id",)))
    assert keys[0] == keys[1] != keys[2] and keys[0][1:] == (5, 0)
