"""Nearest neighbours by vantage-point trees, one per shard of the candidates.

Inner product becomes distance by one more coordinate (the square root of the
largest squared norm less the vector's own), so the triangle inequality applies: a
subtree whose points lie between ``lo`` and ``hi`` from its vantage point cannot
hold anything nearer than max(lo - d, d - hi) to a query at distance d. It is left
out where that bound exceeds ``factor`` times the distance of the k-th neighbour so
far: factor 1 is exact search, smaller ones prune more.

Near points share a shard: at most ``REGIONS`` vantage points, sampled by hash,
divide the space into the cells of their nearest points, and a cell of more than
``shard_rows`` is dealt to several shards. Each query is first searched in one shard of
its own cell, which bounds its k-th distance. Then it goes only to the cells that the
bound leaves open: not those that lie farther by the cell's least or largest distance
from its vantage point, nor by half the difference of the query's distances to that
point and its nearest one. A candidate is shuffled once for each of the two steps,
and a shard's tree is built once in a step; queries stream through it in batches.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; a repeated vec_id counts once, with its smallest usable
vector; vectors are compared with those of the same length; ties go to the smaller
vec_id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, mix, use_checkpoints
from attrition.llm.vectors import matrix, number_type, one_per_id, usable

LEAF = 96
#: Vantage points that divide the vectors of a length, and vectors that are routed or searched at a time.
REGIONS, BATCH_ROWS = 4096, 1024
#: Queries whose ties are scored before the next ones, and numbers of their vectors that are copied at a time.
TIED_ROWS, PAIR_NUMBERS = 128, 1 << 22


@dataclass
class Node:
    points: np.ndarray | None = None  # of a leaf
    vantage: np.ndarray | None = None
    children: list[tuple[float, float, Node]] = field(default_factory=list)  # lo, hi, subtree


def build(x: np.ndarray, idx: np.ndarray, rng: np.random.Generator) -> Node:
    """Splits at the median distance from a vantage point until a leaf is small (or all points are equally far)."""
    if len(idx) > LEAF:
        vantage = x[idx[rng.integers(len(idx))]]
        d = np.sqrt(((x[idx] - vantage) ** 2).sum(1))
        near = d <= np.median(d)
        if not near.all():
            return Node(vantage=vantage, children=[(float(d[m].min()), float(d[m].max()), build(x, idx[m], rng)) for m in (near, ~near)])
    return Node(points=idx)


class Search:
    """A block of queries going through one tree together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float):
        self.x, self.ids, self.q, self.q_ids, self.k, self.factor = x, ids, q, q_ids, k, factor
        self.x2, self.q2 = (x**2).sum(1), (q**2).sum(1)
        self.slack = 1e-9 * (1 + float(self.x2.max(initial=0)) + float(self.q2.max(initial=0)))
        self.best = np.full((len(q), k), np.inf)  # smallest squared distances so far, the largest of them first
        self.first: list[Node | None] = [None] * len(q)

    def squared(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        d = self.q2[rows, None] + self.x2[points] - 2 * (self.q[rows] @ self.x[points].T)
        d[self.q_ids[rows, None] == self.ids[points]] = np.inf
        return np.maximum(d, 0)

    def add(self, rows: np.ndarray, points: np.ndarray) -> None:
        found = np.hstack([self.best[rows], self.squared(rows, points)])
        kept = np.partition(found, self.k - 1, axis=1)[:, : self.k]
        top = kept.argmax(1)
        kept[np.arange(len(rows)), top], kept[:, 0] = kept[:, 0].copy(), kept[np.arange(len(rows)), top]
        self.best[rows] = kept

    def open_rows(self, rows: np.ndarray, d: np.ndarray, lo: float, hi: float) -> np.ndarray:
        bound = np.maximum(np.maximum(lo - d, d - hi), 0)
        return bound <= self.factor * np.sqrt(self.best[rows, 0] + self.slack) + self.slack

    def distance(self, rows: np.ndarray, node: Node) -> np.ndarray:
        v = node.vantage
        return np.sqrt(np.maximum(self.q2[rows] + v @ v - 2 * (self.q[rows] @ v), 0))

    def descend(self, node: Node, rows: np.ndarray) -> None:
        """To each query's nearest leaf first, so that there is a bound to prune with."""
        if not len(rows):
            return
        if node.points is not None:
            self.add(rows, node.points)
            for r in rows:
                self.first[r] = node
            return
        d = self.distance(rows, node)
        inner = d <= node.children[0][1]
        for mask, (_, _, child) in zip((inner, ~inner), node.children, strict=True):
            self.descend(child, rows[mask])

    def narrow(self, node: Node, rows: np.ndarray) -> None:
        """The rest of the tree, pruned by what is known so far."""
        if node.points is not None:
            rest = rows[[self.first[r] is not node for r in rows]]
            if len(rest):
                self.add(rest, node.points)
            return
        d = self.distance(rows, node)
        for lo, hi, child in node.children:
            go = self.open_rows(rows, d, lo, hi)
            if go.any():
                self.narrow(child, rows[go])

    def gather(self, node: Node, rows: np.ndarray, out: list) -> None:
        """Every point not farther than the k-th neighbour: all ties are among them."""
        if node.points is not None:
            near = self.squared(rows, node.points) <= (self.best[rows, 0] + 4 * self.slack)[:, None]
            r, p = np.nonzero(near)
            mine = self.q_ids[rows[r]] != self.ids[node.points[p]]
            out.append((rows[r[mine]], node.points[p[mine]]))
            return
        d = self.distance(rows, node)
        for lo, hi, child in node.children:
            go = self.open_rows(rows, d, lo, hi)
            if go.any():
                self.gather(child, rows[go], out)


class Shard:
    """Points with their tree, which is built once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 1):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        norm2 = (self.x**2).sum(1)
        self.top = float(norm2.max())
        self.raised = np.hstack([self.x, np.sqrt(np.maximum(self.top - norm2, 0))[:, None]])
        self.root = build(self.raised, np.arange(len(x)), np.random.default_rng(seed))

    def nearest(self, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, point, inner product) of each query's k best points, ties to the
        smaller id. ``known``: an inner product that k other points reach (-inf: none);
        points below it may be left out."""
        s = Search(self.raised, self.ids, np.hstack([q, np.zeros((len(q), 1))]), q_ids, k, factor)
        if known is not None:
            s.best[:] = np.where(np.isfinite(known), np.maximum(s.q2 + self.top - 2 * np.where(np.isfinite(known), known, 0), 0) + s.slack, np.inf)[:, None]
        rows, found = np.arange(len(q)), []
        s.descend(self.root, rows)
        s.narrow(self.root, rows)
        step = max(1, PAIR_NUMBERS // q.shape[1])
        for at in range(0, len(q), TIED_ROWS):
            pairs = [(rows[:0], rows[:0])]
            s.gather(self.root, rows[at : at + TIED_ROWS], pairs)
            r, p = (np.concatenate(c) for c in zip(*pairs, strict=True))
            score = np.empty(len(r))
            for lo in range(0, len(r), step):
                score[lo : lo + step] = np.einsum("ij,ij->i", q[r[lo : lo + step]], self.x[p[lo : lo + step]])
            order = np.lexsort((self.ids[p], -score, r))
            r, p, score = r[order], p[order], score[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            found.append((r[best], p[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float = 1.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Shard.nearest`` of points that come by id."""
    return Shard(x, ids, seed).nearest(q, q_ids, k, factor)


@dataclass
class Cells:
    """The division of the space for vectors of one length."""

    points: np.ndarray  # raised vantage points
    top: float  # largest squared norm
    shards: np.ndarray | None = None  # of each cell, 0: empty
    lo: np.ndarray | None = None  # distances of a cell's vectors from its point
    hi: np.ndarray | None = None

    def distances(self, raised: np.ndarray) -> np.ndarray:
        d = (raised**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * raised @ self.points.T
        return np.sqrt(np.maximum(d, 0))

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))[:, None]])

    def open(self, q: np.ndarray, known: np.ndarray, factor: float) -> np.ndarray:
        """Queries x cells that may hold a vector whose inner product with the query is ``known`` at least."""
        d = self.distances(np.hstack([q, np.zeros((len(q), 1))]))
        q2 = (q**2).sum(1)
        reach = np.where(np.isfinite(known), np.sqrt(np.maximum(q2 + self.top - 2 * np.where(np.isfinite(known), known, 0), 0)), np.inf)
        bound = np.maximum(np.maximum(self.lo - d, d - self.hi), (d - d.min(1, keepdims=True)) / 2)
        slack = 1e-6 * (1 + np.sqrt(self.top) + np.sqrt(q2))[:, None]
        return (self.shards > 0) & (bound <= factor * reach[:, None] + slack)


_ROW = pa.schema([("shard", pa.string()), ("asks", pa.bool_()), ("vec_id", pa.int64()), ("embedding", pa.binary()), ("known", pa.float64())])
_ROW_DDL = "shard string, asks boolean, vec_id long, embedding binary, known double"
_PAIR_DDL = "query_id long, vec_id long, score double"


def _by_length(batch: pa.RecordBatch, kind: str):
    """(length, rows, vectors) of the vectors of each length in a batch."""
    raw = batch.column("embedding").to_pylist()
    sizes = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, matrix((raw[i] for i in at), kind)


def _mapped(rows: DataFrame, kind: str, cells, step, schema: pa.Schema, ddl: str) -> DataFrame:
    """``step(cells, ids, vectors, batch rows)`` for the vectors of each length of every batch; it gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                place = part.schema.get_field_index("embedding")
                if pa.types.is_list(part.schema.field(place).type):
                    part = part.set_column(place, "embedding", pa.array([np.asarray(v, kind).tobytes() for v in part.column(place).to_pylist()], pa.binary()))
                for n, at, x in _by_length(part, kind):
                    out = step(cells.value[n], n, part.take(pa.array(at)), x)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return map_arrow(rows, run, ddl)


def _searched(rows: DataFrame, kind: str, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score from rows sorted by shard, candidates before queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw, ids, shard = None, [], [], None
        for batch in batches:
            names, asks = batch.column("shard").to_pylist(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or asks[i] != asks[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if names[a] != at:
                    at, raw, ids, shard = names[a], [], [], None
                if not asks[a]:
                    raw += part.column("embedding").to_pylist()
                    ids += part.column("vec_id").to_pylist()
                    continue
                if shard is None and raw:
                    shard = Shard(matrix(raw, kind), np.array(ids, np.int64))
                    raw = []
                for lo in range(0, part.num_rows if shard else 0, BATCH_ROWS):
                    some = part.slice(lo, BATCH_ROWS)
                    q_ids = some.column("vec_id").to_numpy()
                    r, p, score = shard.nearest(matrix(some.column("embedding").to_pylist(), kind), q_ids, k, factor, some.column("known").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(shard.ids[p]), pa.array(score)], schema=schema)

    return map_arrow(dealt, run, _PAIR_DDL)


def search(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row but itself."""
    spark = vectors.sparkSession
    use_checkpoints(spark)
    kind = number_type(vectors)
    rows = usable(one_per_id(vectors)).select("vec_id", F.size("embedding").alias("length"), "embedding", is_query.alias("is_query"))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("norm2", norm2).checkpoint()
    # one row for each length of vectors
    lengths = {r.length: r for r in rows.groupBy("length").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).collect()}
    many = {n: min(REGIONS, -(-r.n // shard_rows)) for n, r in lengths.items()}
    place = F.row_number().over(W.partitionBy("length").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id"))
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("length")), F.lit(0)) if many else F.lit(0)
    sampled: dict[int, list] = {}
    for r in rows.withColumn("place", place).where((F.col("place") <= REGIONS) & (F.col("place") <= wanted)).select("length", "embedding").collect():  # at most REGIONS of a length
        sampled.setdefault(r.length, []).append(r.embedding)
    cells = {}
    for n, found in sampled.items():
        cells[n] = Cells(np.zeros((0, n + 1)), lengths[n].top)
        cells[n].points = cells[n].raised(np.array(found, np.float64))

    shared = spark.sparkContext.broadcast(cells)
    schema = pa.schema([("length", pa.int32()), ("cell", pa.int32()), ("distance", pa.float64()), ("vec_id", pa.int64()), ("is_query", pa.bool_()), ("embedding", pa.binary())])

    def assign(c, n, part, x):
        d = c.distances(c.raised(x))
        cell = d.argmin(1)
        return np.full(len(x), n), cell, d[np.arange(len(x)), cell], *(part.column(col) for col in ("vec_id", "is_query", "embedding"))

    assigned = _mapped(rows.select("vec_id", "is_query", "embedding"), kind, shared, assign, schema, "length int, cell int, distance double, vec_id long, is_query boolean, embedding binary").checkpoint()
    for n, c in cells.items():
        c.shards, c.lo, c.hi = np.zeros(len(c.points), np.int64), np.zeros(len(c.points)), np.zeros(len(c.points))
    for r in assigned.groupBy("length", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")).collect():  # a row for each cell
        c = cells[r.length]
        c.shards[r.cell], c.lo[r.cell], c.hi[r.cell] = -(-r.n // shard_rows), r.lo, r.hi
    shared = spark.sparkContext.broadcast(cells)

    def to_shard(c, n, part, x):
        cell, ids = part.column("cell").to_numpy(), part.column("vec_id").to_numpy()
        own = mix(ids.astype(np.uint64)) % c.shards[cell].astype(np.uint64)
        return [f"{n}/{a}/{b}" for a, b in zip(cell, own, strict=True)], np.zeros(len(x), bool), ids, part.column("embedding"), np.full(len(x), -np.inf)

    candidates = _mapped(assigned, kind, shared, to_shard, _ROW, _ROW_DDL)

    def first_shard(c, n, part, x):
        d = np.where(c.shards > 0, c.distances(np.hstack([x, np.zeros((len(x), 1))])), np.inf)
        cell, ids = d.argmin(1), part.column("vec_id").to_numpy()
        own = mix(ids.astype(np.uint64) + np.uint64(1)) % c.shards[cell].astype(np.uint64)
        return [f"{n}/{a}/{b}" for a, b in zip(cell, own, strict=True)], np.ones(len(x), bool), ids, part.column("embedding"), np.full(len(x), -np.inf)

    queries = assigned.where("is_query")
    asked = _mapped(queries, kind, shared, first_shard, _ROW, _ROW_DDL)
    best_first = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    begun = _searched(candidates.unionByName(asked), kind, k, factor).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = begun.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("known"))
    queries = queries.join(known, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))

    def open_shards(c, n, part, x):
        score = part.column("known").to_numpy()
        row, cell = np.nonzero(c.open(x, score, factor))
        times = c.shards[cell]
        row, cell = np.repeat(row, times), np.repeat(cell, times)
        own = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(times)[:-1]), times) if len(times) else row
        return [f"{n}/{a}/{b}" for a, b in zip(cell, own, strict=True)], np.ones(len(row), bool), part.column("vec_id").to_numpy()[row], part.column("embedding").take(pa.array(row)), score[row]

    sent = _mapped(queries, kind, shared, open_shards, _ROW, _ROW_DDL)
    found = _searched(candidates.unionByName(sent), kind, k, factor)
    rank = F.row_number().over(best_first)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
