"""Boosted trees as Spark jobs: binning, the rounds, scoring.

The feature table is binned once: quantile cuts of each feature from one
aggregate, then blocks of rows with one byte a value, written to the run's folder.

* A table of more than ``ROWS_PER_TASK`` rows is spread over the tasks of a barrier
  stage, which runs ``ROUNDS_PER_STATE`` rounds. Every task keeps its rows; for each
  level it sums their histograms and deals them to its peers by feature
  (``plans/peers.py``). A task adds up its share of the features, picks the best
  splits among them and tells them to all; the best of these is the split. No task
  sees another's rows, and none goes to the driver. Margins are written back with the
  blocks at the end of a stretch.
* Where such a stage can't run (``together``: no fixed number of slots, storage that
  Python can't reach, more than ``MOST_TOGETHER`` tasks of ``HELD_ROWS`` rows), there is
  a job for each level: every task sums its blocks' histograms, Spark adds them up,
  and the driver, which receives one row for each open node and bin (bounded by
  depth, features and bins, whatever the rows), picks the splits. Margins are
  written back every ``REPLAYED_ROUNDS`` rounds, so a job replays few trees.
* A smaller table is one task's work anyway: there is nothing to add up, so a job
  runs ``ROUNDS_PER_JOB`` rounds.

All three have the same kernels and, as sums are exact, the same trees.

Each stretch of rounds is a folder of nodes with Spark's completion marker. A fit
called again with the same folder, parameters and rows goes on after the last one;
other parameters or rows lead to another subfolder.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.config import Params
from attrition.operators.boosting import (
    BLOCK_ROWS, NODE_COLUMNS, Bins, Forest, Packed, Tree, best_splits, fixed_point, gradients, grow, grow_by, histogram, log_loss,
    roots, sampled_features, sampled_rows, trees_of,
)
from attrition.plans.peers import Peers, shared as reachable
from attrition.session import Storage, reach_workers

ROWS_PER_TASK = 50_000
ROUNDS_PER_JOB = 100
ROUNDS_PER_STATE = 250
#: With a job for each level: trees that a job replays at most.
REPLAYED_ROUNDS = 10
#: Rows of a block as written: small, so that blocks can be dealt evenly.
STORED_ROWS = 1 << 11
#: Tasks of a barrier stage, and rows that one of them holds, at most.
MOST_TOGETHER = 64
HELD_ROWS = 1 << 21
#: Tasks whose histograms the driver may receive one by one: at most depth 6, 48 x 256 bins and 16 bytes a bin, 6 MB each.
DIRECT_TASKS = 16
#: Largest model that scoring broadcasts.
MODEL_BYTES = 1 << 28

_BLOCK = pa.schema([("keys", pa.binary()), ("label", pa.binary()), ("train", pa.binary()), ("bins", pa.binary()), ("margin", pa.binary())])
_BLOCK_DDL = "keys binary, label binary, train binary, bins binary, margin binary"
_NODES = pa.schema([("round", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("cut", pa.float64()), ("left", pa.int32()), ("value", pa.float64()), ("gain", pa.float64())])
#: What the tasks of a barrier stage leave: nodes, and their rows as blocks with margins.
_MET = pa.schema([*_NODES, *_BLOCK])
#: In a stretch's table, ``node`` of the row with the mean log loss of the training (value) and validation part (gain).
LOSS = -1


@dataclass
class Model:
    """Trees over the named features; ``losses``: mean log loss of both parts after each round."""

    features: list[str]
    trees: list[Tree]
    max_depth: int
    losses: list[tuple] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = pd.concat([t.frame(r) for r, t in enumerate(self.trees)]) if self.trees else pd.DataFrame(columns=_NODES.names)
        return spark.createDataFrame(pa.Table.from_pandas(rows[_NODES.names], schema=_NODES, preserve_index=False))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of the gain of all splits."""
        gain = np.zeros(len(self.features))
        for t in self.trees:
            at = t.feature >= 0
            np.add.at(gain, t.feature[at], t.gain[at])
        return list(zip(self.features, (gain / max(gain.sum(), 1e-300)).tolist(), strict=True))


def read_nodes(spark: SparkSession, path: str) -> list[Tree]:
    """Trees of a node table; at most 2^(depth + 1) nodes for each round."""
    return trees_of(spark.read.schema(NODE_COLUMNS).parquet(path).where(F.col("node") != LOSS).toPandas())


@dataclass
class Block:
    """Rows of the binned table in a task."""

    keys: np.ndarray
    y: np.ndarray
    train: np.ndarray
    bins: np.ndarray
    margin: np.ndarray


    def row(self, start: int, end: int) -> dict:
        """Some of the rows as they are stored."""
        part = {"keys": self.keys, "label": self.y, "train": self.train.astype(np.uint8), "bins": self.bins, "margin": self.margin}
        return {c: v[..., start:end].tobytes() for c, v in part.items()}


def blocks_of(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[Block]:
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], np.int64)
            margin = np.zeros(len(keys)) if r["margin"] is None else np.frombuffer(r["margin"]).copy()
            y, train = (np.frombuffer(r[c], np.uint8) for c in ("label", "train"))
            yield Block(keys, y, train > 0, np.frombuffer(r["bins"], np.uint8).reshape(n_features, -1), margin)


def _number(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))


def feature_cuts(rows: DataFrame, features: list[str], max_bins: int) -> Bins:
    """Quantile cuts of each feature in one aggregate; values of the table, distinct."""
    shares = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])  # once: 48 lists of literals took some 11 s to build
    got = rows.agg(*[F.percentile_approx(_number(f), shares, 50 * max_bins).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return Bins([np.array(c if c is not None else [0.0]) for c in got])


def write_binned(table: DataFrame, features: list[str], label: str, bins: Bins, key_cols: tuple[str, ...], path: str) -> None:
    """The table as blocks of rows with one byte for each feature; ``split`` tells the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STORED_ROWS):
                batch = whole.slice(a, STORED_ROWS)
                x = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(bins.cuts))], axis=1)
                flag = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()  # noqa: B023, E731
                row = {"keys": batch.column("key").to_numpy().astype(np.int64).tobytes(), "label": flag("label"), "train": flag("train"), "bins": bins.bin(x).tobytes(), "margin": None}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    rows = table.select(
        F.xxhash64(*key_cols).alias("key"), (F.col(label) == 1).alias("label"), (F.col("split") == "train").alias("train"),
        *[_number(f).alias(f"f{i}") for i, f in enumerate(features)],
    )
    rows.mapInArrow(run, _BLOCK_DDL).write.mode("overwrite").parquet(path)


@dataclass
class Fit:
    """What every task of a fit needs."""

    bins: Bins
    p: Params
    spw: float
    scale: float
    n_train: int
    n_validation: int
    tasks: int = 0  # of a barrier stage, 0: a job for each level
    meet: str = ""  # URI of the folder where those tasks meet
    state: str = ""  # folder of the blocks with margins after each stretch

    def columns(self, round_: int) -> np.ndarray:
        return sampled_features(len(self.bins.cuts), round_, self.p)

    def losses(self, blocks: list[Block]) -> tuple[float, float]:
        return tuple(sum(log_loss(b.margin[part(b)], b.y[part(b)]) for b in blocks) for part in (lambda b: b.train, lambda b: ~b.train))

    def mean(self, train: float, validation: float) -> tuple:
        return train / max(self.n_train, 1), validation / self.n_validation if self.n_validation else None

    def sums(self, b: Block, round_: int, tree: Tree, open_: list[int], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block's histograms of the rows that the round sees, at the open nodes."""
        place = np.full(len(tree.feature), -1, np.int32)
        place[open_] = np.arange(len(open_))
        node = tree.down(roots(len(b.keys), len(tree.feature)), b.bins)
        seen = b.train & sampled_rows(b.keys, round_, self.p)
        return histogram(b.bins, np.where(seen, place[node], -1), *gradients(b.margin, b.y, self.spw, self.scale), self.bins, columns, len(open_))


def split_of(tree: Tree, nodes: Iterable[int]) -> list[int]:
    return [q for q in nodes if tree.feature[q] >= 0]


def loss_row(round_: int, losses: tuple) -> pd.DataFrame:
    return pd.DataFrame([(round_, LOSS, -1, 0, 0.0, 0, *losses, )], columns=_NODES.names)


def _table(frames: list[pd.DataFrame]) -> pa.Table:
    return pa.Table.from_pandas(pd.concat(frames)[_NODES.names], schema=_NODES, preserve_index=False)


def rounds_in_a_task(blocks: DataFrame, fit: Fit, trees: list[Tree], stop: int) -> DataFrame:
    """Node rows of the rounds up to ``stop``, all run by the one task that has the rows."""
    shared = blocks.sparkSession.sparkContext.broadcast((fit, trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, trees = shared.value
        held = list(joined(blocks_of(batches, len(fit.bins.cuts))))
        for b in held:
            for t in trees:
                b.margin += t.values(b.bins)
        packed = [Packed(b.bins, fit.bins) for b in held]
        for r in range(len(trees), stop):
            columns = fit.columns(r)
            seen = [b.train & sampled_rows(b.keys, r, fit.p) for b in held]
            gh = [gradients(b.margin, b.y, fit.spw, fit.scale) for b in held]
            node = [roots(len(b.keys), 2 ** (fit.p.max_depth + 1)) for b in held]
            kept = {}

            def histograms(tree, open_):
                # rows go down one level at a time; of two siblings the one with fewer rows is summed, the other is the rest
                place = np.full(len(tree.feature), -1, np.int32)
                pairs = {int(tree.left[q]): q for q in kept if tree.feature[q] >= 0 and {int(tree.left[q]), int(tree.left[q]) + 1} & set(open_)}
                if kept:
                    for b, n in zip(held, node, strict=True):
                        tree.down(n, b.bins, split_of(tree, kept))
                    rows = sum(np.bincount(n[s], minlength=len(tree.feature)) for n, s in zip(node, seen, strict=True))
                    todo = [a if rows[a] <= rows[a + 1] else a + 1 for a in pairs]
                else:
                    todo = open_
                place[todo] = np.arange(len(todo))
                parts = [b.histogram(np.where(s, place.take(n), -1), *v, columns, len(todo)) for b, s, n, v in zip(packed, seen, node, gh, strict=True)]
                got = dict(zip(todo, zip(sum(p[0] for p in parts), sum(p[1] for p in parts), strict=True), strict=True))
                for a, q in pairs.items():
                    done, rest = (a, a + 1) if a in got else (a + 1, a)
                    got[rest] = tuple(kept[q][j] - got[done][j] for j in (0, 1))
                kept.clear()
                kept.update(got)
                return tuple(np.stack([got[n][j] for n in open_]) for j in (0, 1))

            tree = grow(histograms, fit.bins, columns, fit.p, fit.scale)
            for b, n in zip(held, node, strict=True):
                b.margin += tree.value.take(tree.down(n, b.bins, split_of(tree, kept)))
            yield from _table([tree.frame(r), loss_row(r, fit.mean(*fit.losses(held)))]).to_batches()

    return blocks.coalesce(1).mapInArrow(run, NODE_COLUMNS)


def joined(blocks: Iterator[Block]) -> Iterator[Block]:
    """The blocks as few larger ones, of at most ``BLOCK_ROWS`` rows."""

    def one():
        return Block(*(np.concatenate([getattr(b, c) for b in some], axis=-1) for c in ("keys", "y", "train", "bins", "margin")))

    some: list[Block] = []
    for b in blocks:
        if some and sum(len(x.keys) for x in some) + len(b.keys) > BLOCK_ROWS:
            yield one()
            some = []
        some.append(b)
    if some:
        yield one()


def level_sums(blocks: DataFrame, fit: Fit, since: list[Tree], round_: int, tree: Tree, open_: list[int]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Histograms of the open nodes over all tasks, and the losses before this round. Up to
    ``DIRECT_TASKS`` tasks send theirs to the driver; those of more are added up by Spark first."""
    shared = blocks.sparkSession.sparkContext.broadcast((fit, since, tree))
    whole, shape = 1 << 20, (len(open_), fit.bins.total)
    size = shape[0] * shape[1]

    def of_a_task(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        fit, since, tree = shared.value
        columns, loss = fit.columns(round_), np.zeros(2)
        G, H = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in joined(blocks_of(batches, len(fit.bins.cuts))):
            for t in since:
                b.margin += t.values(b.bins)
            if len(tree.feature) == 1:
                loss += fit.losses([b])
            if open_:
                g, h = fit.sums(b, round_, tree, open_, columns)
                G += g.ravel()
                H += h.ravel()
        return G, H, [int(x * whole) for x in loss]

    def to_driver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, loss = of_a_task(batches)
        yield pa.RecordBatch.from_pylist([{"g": g.tobytes(), "h": h.tobytes(), "train": loss[0], "validation": loss[1]}])

    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, loss = of_a_task(batches)
        at = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(g[at], loss[0])), pa.array(np.append(h[at], loss[1]))], names=["slot", "g", "h"])

    G, H, loss = np.zeros(size, np.int64), np.zeros(size, np.int64), [0, 0]
    if fit.n_train + fit.n_validation <= DIRECT_TASKS * ROWS_PER_TASK:
        for r in blocks.coalesce(DIRECT_TASKS).mapInArrow(to_driver, "g binary, h binary, train long, validation long").collect():
            G += np.frombuffer(r["g"], np.int64)
            H += np.frombuffer(r["h"], np.int64)
            loss = [loss[0] + r["train"], loss[1] + r["validation"]]
    else:
        rows = blocks.mapInArrow(by_slot, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        slot, g, h = (rows[c].to_numpy(np.int64) for c in ("slot", "g", "h"))
        at = slot >= 0
        G[slot[at]], H[slot[at]] = g[at], h[at]
        loss = [g[~at].sum(), h[~at].sum()]
    shared.unpersist()
    return G.reshape(shape), H.reshape(shape), (loss[0] / whole, loss[1] / whole)


def together(spark: SparkSession, rows: int, wanted: int, storage: Storage, folder: str) -> tuple[int, str]:
    """How many tasks can run the rounds in one barrier stage (0: none), and the URI of the folder where they meet."""
    sc = spark.sparkContext
    conf = sc.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true" or conf.get("spark.default.parallelism", None):
        return 0, ""
    tasks = min(wanted, MOST_TOGETHER, sc.defaultParallelism // int(conf.get("spark.task.cpus", "1")))
    meet = storage.make(folder)
    return (tasks, meet) if tasks > 1 and rows <= tasks * HELD_ROWS and reachable(meet) else (0, "")


def rounds_together(blocks: DataFrame, fit: Fit, before: int, stop: int) -> tuple[list[Tree], list[tuple]]:
    """Trees of the rounds before..stop from one barrier stage, whose tasks each keep a part of the rows."""
    spark, meet = blocks.sparkSession, f"{fit.meet}/{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, peers = shared.value, Peers(meet)
        held = list(joined(blocks_of(batches, len(fit.bins.cuts))))
        packed = [Packed(b.bins, fit.bins) for b in held]
        grown, losses = [], []
        for r in range(before, stop):
            columns = fit.columns(r)
            shares = np.array_split(columns, peers.n)
            mine = shares[peers.me]
            part = Bins([fit.bins.cuts[f] for f in mine]) if len(mine) else None
            places = [np.concatenate([np.arange(fit.bins.first[f], fit.bins.first[f] + fit.bins.sizes[f]) for f in s]) if len(s) else np.zeros(0, int) for s in shares]
            seen = [b.train & sampled_rows(b.keys, r, fit.p) for b in held]
            gh = [gradients(b.margin, b.y, fit.spw, fit.scale) for b in held]
            node = [roots(len(b.keys), 2 ** (fit.p.max_depth + 1)) for b in held]
            kept, weight = {}, {}

            def splits(tree, open_):
                # as in one task: of two siblings the lighter one is summed, the other is what it leaves of their parent
                place = np.full(len(tree.feature), -1, np.int32)
                parents = {int(tree.left[q]): q for q in kept if tree.feature[q] >= 0 and {int(tree.left[q]), int(tree.left[q]) + 1} & set(open_)}
                for b, n in zip(held, node, strict=True):
                    tree.down(n, b.bins, split_of(tree, kept))
                todo = [a if weight[q][1] <= weight[q][0] - weight[q][1] else a + 1 for a, q in parents.items()] if kept else open_
                place[todo] = np.arange(len(todo))
                G, H = (np.zeros((len(todo), fit.bins.total), np.int64) for _ in range(2))
                for b, s, n, v in zip(packed, seen, node, gh, strict=True):
                    g, h = b.histogram(np.where(s, place.take(n), -1), *v, columns, len(todo))
                    G += g
                    H += h
                sums = sum(np.frombuffer(x, np.int64) for x in peers.deal([np.stack([G[:, at], H[:, at]]).tobytes() for at in places])).reshape(2, len(todo), -1)
                got = {q: sums[:, i] for i, q in enumerate(todo)}
                for a, q in parents.items():
                    done, rest = (a, a + 1) if a in got else (a + 1, a)
                    got[rest] = kept[q] - got[done]
                kept.clear()
                kept.update(got)
                best = []
                if len(mine):
                    G, H = np.stack([got[q] for q in open_], axis=1)
                    for gain, at, whole, left in best_splits(G, H, part, np.arange(len(mine)), fit.p, fit.scale):
                        f = part.feature[at]
                        best.append((gain, int(fit.bins.first[mine[f]] + at - part.first[f]), whole, left))
                said = [x for x in map(pickle.loads, peers.tell(pickle.dumps(best))) if x]
                # of equal gains the first, and tasks have their features in order
                chosen = [max((x[i] for x in said), key=lambda x: x[0]) for i in range(len(open_))]
                weight.clear()
                weight.update({q: (whole[1], left[1]) for q, (_, _, whole, left) in zip(open_, chosen, strict=True)})
                return chosen

            tree = grow_by(splits, fit.bins, fit.p, fit.scale)
            for b, n in zip(held, node, strict=True):
                b.margin += tree.value.take(tree.down(n, b.bins, split_of(tree, kept)))
            grown.append((r, tree))
            losses.append((r, fit.losses(held)))
        frames = [t.frame(r) for r, t in grown] if peers.me == 0 else []  # at the end: here the others don't wait for it
        for batch in _table(frames + [loss_row(*x) for x in losses]).to_batches():
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, f.type) for f in _BLOCK)], schema=_MET)
        if stop < fit.p.rounds:  # the next stretch starts from these
            for b in held:
                for a in range(0, len(b.keys), STORED_ROWS):
                    yield pa.RecordBatch.from_pylist([b.row(a, a + STORED_ROWS)], schema=_MET)

    # the shuffle behind it lets Spark run the stage again if a task is lost
    met = blocks.repartition(fit.tasks).mapInArrow(run, f"{NODE_COLUMNS}, {_BLOCK_DDL}", barrier=True)
    met.repartition(fit.tasks).write.mode("overwrite").parquet(f"{fit.state}/{stop:06d}")
    shared.unpersist()
    Storage(spark, meet).delete(meet)
    rows = spark.read.schema(NODE_COLUMNS).parquet(f"{fit.state}/{stop:06d}").where(F.col("node").isNotNull()).toPandas()
    losses = rows[rows["node"] == LOSS].groupby("round", sort=True)[["value", "gain"]].sum()
    return trees_of(rows[rows["node"] != LOSS]), [fit.mean(*x) for x in losses.to_numpy().tolist()]


def rounds_by_level(blocks: DataFrame, fit: Fit, before: int, stop: int) -> tuple[list[Tree], list[tuple]]:
    """Trees of the rounds before..stop, grown level by level; blocks carry the margins of the rounds before."""
    if fit.tasks:
        return rounds_together(blocks, fit, before, stop)
    since, losses, root = [], [], Tree(*(np.array([x]) for x in (-1, 0, 0.0, 0, 0.0, 0.0)))
    for r in range(before, stop):
        columns = fit.columns(r)

        def histograms(tree, open_):
            G, H, loss = level_sums(blocks, fit, since, r, tree, open_)  # noqa: B023
            if len(tree.feature) == 1:
                losses.append(loss)
            return G, H

        since.append(grow(histograms, fit.bins, columns, fit.p, fit.scale))
    losses.append(level_sums(blocks, fit, since, stop, root, [])[2])
    return since, [fit.mean(*x) for x in losses[1:]]


def with_margins(blocks: DataFrame, fit: Fit, since: list[Tree]) -> DataFrame:
    """The blocks with the margins after the trees ``since``."""
    shared = blocks.sparkSession.sparkContext.broadcast(since)
    n = len(fit.bins.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for b in blocks_of([batch], n):
                for t in shared.value:
                    b.margin += t.values(b.bins)
                margins.append(b.margin.tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(run, _BLOCK_DDL)


def fit_key(table: DataFrame, features: list[str], label: str, spw: float, params: Params, key_cols: tuple[str, ...]) -> tuple[str, int, int]:
    """What the fit depends on as a hash, and the rows of both parts."""
    content = F.xxhash64(*key_cols, label, "split", *[F.rint(_number(f) * 1e6) + F.lit(0.0) for f in features])
    train = F.col("split") == "train"
    r = table.agg(F.sum(content.cast("decimal(38,0)")).alias("sum"), F.count_if(train).alias("n"), F.count_if(~train).alias("v")).first()
    said = json.dumps([asdict(params), features, label, spw, str(r["sum"]), r["n"], r["v"]])
    return hashlib.sha256(said.encode()).hexdigest()[:32], r["n"], r["v"]


def train_gbt(table: DataFrame, features: list[str], label: str, spw: float, params: Params, folder: str, key_cols: tuple[str, ...] = ("userId", "date")) -> Model:
    """Fits on the rows whose ``split`` is ``train`` and follows the loss on the others.
    ``folder`` holds the state; calling again with it resumes. A missing feature
    counts as 0. Without rows or with zero rounds the model says 1/2."""
    spark = table.sparkSession
    reach_workers(spark)
    storage = Storage(spark, folder)
    key, n_train, n_validation = fit_key(table, features, label, spw, params, key_cols)
    folder = f"{folder}/{key}"
    if not storage.written(f"{folder}/cuts"):
        bins = feature_cuts(table.where(F.col("split") == "train"), features, params.max_bins)
        spark.range(1).select(F.lit(json.dumps([c.tolist() for c in bins.cuts])).alias("cuts")).coalesce(1).write.mode("overwrite").json(f"{folder}/cuts")
    bins = Bins([np.array(c) for c in json.loads(spark.read.schema("cuts string").json(f"{folder}/cuts").first()["cuts"])])
    tasks = max(1, -(-(n_train + n_validation) // ROWS_PER_TASK))
    if not storage.written(f"{folder}/binned"):
        write_binned(table.coalesce(1) if tasks == 1 else table, features, label, bins, key_cols, f"{folder}/binned")
    slots = together(spark, n_train + n_validation, 2 * tasks, storage, f"{folder}/meet") if tasks > 1 else (0, "")
    fit = Fit(bins, params, float(spw), fixed_point(n_train, spw), n_train, n_validation, *slots, state=f"{folder}/state")

    stretches = [x for x in storage.names(f"{folder}/trees") if storage.written(f"{folder}/trees/{x}")]
    rounds = int(stretches[-1]) if stretches else 0
    trees: list[Tree] = []
    losses: list[tuple] = []

    def take(stretch: str) -> list[Tree]:
        got = spark.read.schema(NODE_COLUMNS).parquet(f"{folder}/trees/{stretch}").toPandas()
        loss = got[got["node"] == LOSS].sort_values("round")
        losses.extend((a, None if b != b else b) for a, b in zip(loss["value"].tolist(), loss["gain"].tolist(), strict=True))
        return trees_of(got[got["node"] != LOSS])

    for x in stretches:
        trees += take(x)
    schema = _BLOCK_DDL
    blocks = spark.read.schema(schema).parquet(f"{folder}/binned")
    while rounds < params.rounds and n_train:
        if tasks == 1:
            stop = min(params.rounds, rounds + ROUNDS_PER_JOB)
            rounds_in_a_task(blocks, fit, trees, stop).write.mode("overwrite").parquet(f"{folder}/trees/{stop:06d}")
            trees += take(f"{stop:06d}")
        else:
            stop = min(params.rounds, rounds + (ROUNDS_PER_STATE if fit.tasks else min(ROUNDS_PER_STATE, REPLAYED_ROUNDS)))
            state = spark.read.schema(schema).parquet(f"{fit.state}/{rounds:06d}").where(F.col("keys").isNotNull()) if rounds else blocks
            since, loss = rounds_by_level(state, fit, rounds, stop)
            if not fit.tasks and stop < params.rounds:
                with_margins(state, fit, since).write.mode("overwrite").parquet(f"{fit.state}/{stop:06d}")
            frames = [x for r, (t, pair) in enumerate(zip(since, loss, strict=True), rounds) for x in (t.frame(r), loss_row(r, pair))]
            spark.createDataFrame(_table(frames)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trees/{stop:06d}")
            for old in storage.names(fit.state):
                if int(old) < stop:
                    storage.delete(f"{fit.state}/{old}")
            trees += since
            losses += loss
        rounds = stop
    return Model(features, trees, params.max_depth, losses)


def predict_proba(model: Model, df: DataFrame) -> DataFrame:
    """Adds ``probability`` = P(class 1): all trees for whole Arrow batches, level by level."""
    forest = Forest(model.trees, len(model.features))
    if forest.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {forest.nbytes} bytes is more than is broadcast ({MODEL_BYTES})")
    reach_workers(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-shared.value.margins(x.to_numpy(float)))))

    return df.withColumn("probability", score(F.struct(*[_number(f).alias(f"f{i}") for i, f in enumerate(model.features)])))
