"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c means a squared distance of at most 2 - 2c. After
a seeded rotation the coordinates are split into low-dimensional blocks; if
every block's squared distance exceeded its share of that budget (in proportion
to its dimensions), so would the whole. So each pair lies within the budget in
some block. Each block is range-joined on a grid over its first coordinates: a
vector is at home in one cell and is sent, as a candidate, to those cells it could
reach that are not before its own, so that of two vectors one is sent to the other.
A pair found in several blocks is handled in the first of them only, and verified
exactly, in double precision, where it is found.

Equal vectors are one class throughout and are never paired. Links are counted
where they are found and folded into counts and labels slice by slice; only
these and a spanning forest of a task's links leave it, so neither its memory
nor its output grows with the square of a group. Cells with many vectors are
dealt out over tiles of at most ``tile`` home and ``tile`` candidate vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a repeated vec_id counts once; null vec_ids are
left out; vectors of different lengths never link; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, use_checkpoints
from attrition.llm.components import components
from attrition.llm.vectors import matrix, number_type, one_per_id, usable

BLOCK_DIMENSIONS, GRID_DIMENSIONS = 16, 2
#: More than what rounding can change in a squared distance, of doubles and (a part of it for each dimension) of the 32-bit floats of the first tests.
ROUNDING, ROUGH, ROUGH_PART = 1e-9, 1e-5, 1e-6
_CELLS = "length int, part int, cell long, home boolean, rep long, n long, vector binary"


@lru_cache
def rotation(length: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((length, length)))[0]


def unit_and_turned(x: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and those rotated. Column by column, so that a vector
    gets the same bits in every task, whatever other vectors are there; a few rows at
    a time, which stay in the processor's cache."""
    unit, turned, r = np.empty_like(x), np.zeros_like(x), rotation(x.shape[1])
    for at in range(0, len(x), step):
        own, out = x[at : at + step], turned[at : at + step]
        norm2 = np.zeros(len(own))
        for j in range(x.shape[1]):
            norm2 += own[:, j] ** 2
        unit[at : at + step] = own = own / np.sqrt(norm2)[:, None]
        for j in range(x.shape[1]):
            out += own[:, j : j + 1] * r[j]
    return unit, turned


def parts(length: int) -> list[slice]:
    cuts = np.linspace(0, length, max(1, length // BLOCK_DIMENSIONS) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def budgets(length: int, cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * (s.stop - s.start) / length + ROUNDING for s in parts(length)])


def grid(y: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell, in whole steps, of points and of the lower and upper corner of what they reach,
    at most one cell further. The last steps differ by one at most, whatever the rounding."""
    y, radius = y[:, :GRID_DIMENSIONS], float(np.sqrt(budget))
    width = 2 * radius * (1 + ROUNDING)
    return tuple(np.floor((y + d) / width).astype(np.int64) for d in (0, -radius, radius))


def cell_code(steps: np.ndarray) -> np.ndarray:
    return (steps + (1 << 15)) @ (1 << 16) ** np.arange(steps.shape[1], dtype=np.int64)


def _cells(kind: str, cosine: float):
    types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema([(n.split()[0], t) for n, t in zip(_CELLS.split(", "), types, strict=True)])

    def place(rep: np.ndarray, n: np.ndarray, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = matrix(raw, kind)
        length = x.shape[1]
        _, turned = unit_and_turned(x)
        raw = np.array(raw, object)
        for k, (s, budget) in enumerate(zip(parts(length), budgets(length, cosine), strict=True)):
            at, low, high = grid(turned[:, s], budget)
            own = cell_code(at)
            cells, who, home = [own], [np.arange(len(rep))], [np.ones(len(rep), bool)]
            for shift in np.ndindex(*(2,) * at.shape[1]):
                corner = cell_code(np.where(np.array(shift), high, low))
                reached = ((np.array(shift) == 0) | (high > low)).all(1) & (corner >= own)
                cells.append(corner[reached])
                who.append(np.flatnonzero(reached))
                home.append(np.zeros(reached.sum(), bool))
            cell, i, is_home = (np.concatenate(a) for a in (cells, who, home))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), v), t) for v, t in ((length, pa.int32()), (k, pa.int32()))] + [pa.array(cell), pa.array(is_home), pa.array(rep[i]), pa.array(n[i]), pa.array(raw[i], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rep, n = (batch.column(c).to_numpy() for c in ("rep", "n"))
                raw = [np.asarray(v, kind).tobytes() for v in batch.column("embedding").to_pylist()]
                size = np.array([len(r) for r in raw])
                for length in np.unique(size):
                    pick = np.flatnonzero(size == length)
                    yield from place(rep[pick], n[pick], [raw[i] for i in pick])

    return run


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per node the smallest node it reaches by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join_tile(part: int, cosine: float, h: tuple, c: tuple, rows: int = 256, cols: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (home, candidate) that link and for which this part is the first within its budget,
    in slices of bounded size; of two vectors the one of the later cell, or of the larger rep in a
    cell, is the home. h and c hold (rep, vectors)."""
    (rep_h, x_h), (rep_c, x_c) = h, c
    (unit_h, t_h), (unit_c, t_c) = unit_and_turned(x_h), unit_and_turned(x_c)
    all_parts, limit = parts(t_h.shape[1]), budgets(t_h.shape[1], cosine)
    s, rough = all_parts[part], ROUGH + ROUGH_PART * t_h.shape[1]
    y_h, y_c = t_h[:, s], t_c[:, s]
    cell_h, cell_c = (cell_code(grid(y, limit[part])[0]) for y in (y_h, y_c))
    lead = min(GRID_DIMENSIONS, y_h.shape[1] - 1)
    order_h, order_c = np.argsort(y_h[:, lead]), np.argsort(y_c[:, lead])
    line = y_c[order_c, lead]
    wide_h = np.hstack([-2 * y_h, (y_h**2).sum(1, keepdims=True), np.ones((len(y_h), 1))]).astype(np.float32)[order_h]
    wide_c = np.hstack([y_c, np.ones((len(y_c), 1)), (y_c**2).sum(1, keepdims=True)]).astype(np.float32)[order_c]
    short_h, short_c = t_h.astype(np.float32), t_c.astype(np.float32)
    radius = float(np.sqrt(limit[part])) + 1e-6
    for at in range(0, len(order_h), rows):
        own = order_h[at : at + rows]
        a, b = np.searchsorted(line, [y_h[own[0], lead] - radius, y_h[own[-1], lead] + radius + 1e-6])
        for lo in range(a, b, cols):
            hi = min(lo + cols, b)
            i, j = np.divmod(np.flatnonzero(wide_h[at : at + rows] @ wide_c[lo:hi].T <= limit[part] + rough), hi - lo)
            i, j = own[i], order_c[lo + j]
            later = (cell_h[i] > cell_c[j]) | ((cell_h[i] == cell_c[j]) & (rep_h[i] > rep_c[j]))
            i, j = i[later], j[later]
            for k in range(0, len(i), 1 << 14):
                p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                likely = np.einsum("ij,ij->i", short_h[p], short_c[q]) >= cosine - rough
                p, q = p[likely], q[likely]
                gap = (t_h[p] - t_c[q]) ** 2
                within = np.add.reduceat(gap, [x.start for x in all_parts], axis=1) <= limit
                mine = within[:, part] & ~within[:, :part].any(1)
                p, q = p[mine], q[mine]
                link = np.einsum("ij,ij->i", unit_h[p], unit_c[q]) >= cosine
                if link.any():
                    yield p[link], q[link]


def _tiles(kind: str, cosine: float):
    def run(key, group):
        home = group.home.to_numpy(bool)
        reps, n = group.rep.to_numpy(), group.n.to_numpy()
        out = {"rep": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "n_links": np.zeros(0, np.int64)}
        if home.any() and not home.all():
            x = matrix(group.vector, kind)
            names, at = np.unique(np.concatenate([reps[home], reps[~home]]), return_inverse=True)
            at_h, at_c, n_h, n_c = at[: home.sum()], at[home.sum() :], n[home], n[~home]
            links, label = np.zeros(len(names), np.int64), np.arange(len(names))
            for i, j in join_tile(int(key[1]), cosine, (reps[home], x[home]), (reps[~home], x[~home])):
                np.add.at(links, at_h[i], n_c[j])
                np.add.at(links, at_c[j], n_h[i])
                a, b = label[at_h[i]], label[at_c[j]]
                if (a != b).any():
                    label = smallest_labels(a[a != b], b[a != b], len(names))[label]
            used = np.flatnonzero((links > 0) | (label != np.arange(len(names))))
            out = {"rep": names[used], "other": names[label[used]], "n_links": links[used]}
        return pd.DataFrame(out)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, tile: int = 16384) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vec_id."""
    use_checkpoints(vectors.sparkSession)
    kind = number_type(vectors)
    rows = one_per_id(vectors)
    classes = usable(rows).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    cells = map_arrow(classes, _cells(kind, cosine), _CELLS)
    key = ["length", "part", "cell"]
    size = cells.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("others"))
    dealt = size.select(*key, F.ceil(F.col("homes") / tile).cast("int").alias("rows"), F.ceil(F.col("others") / tile).cast("int").alias("cols")).where("rows > 0")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # coordinates lie between -1 and 1, so cells are bounded by the vectors' length, not by their number
    sides = cells.join(F.broadcast(dealt), key)
    sides = sides.withColumn("row", F.explode(F.when(F.col("home"), F.array(own("rows"))).otherwise(span("rows"))))
    sides = sides.withColumn("col", F.explode(F.when(F.col("home"), span("cols")).otherwise(F.array(own("cols")))))
    found = sides.drop("rows", "cols").groupBy(*key, "row", "col").applyInPandas(_tiles(kind, cosine), "rep long, other long, n_links long").checkpoint()
    links = found.groupBy("rep").agg(F.sum("n_links").alias("links"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    per_class = classes.join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(per_class, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


DUPLICATES_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least_of m ON m.a = e.vec_id WHERE vec_id IS NOT NULL
"""
