"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over hashed words and the first bytes of longer ones is trained
with numpy from confirmed toxic texts (P) and texts whatever their label (U).
The risk is corrected by the class prior pi: pi * R_P(+) plus the negative risk
R_U(-) - pi * R_P(-), which is kept from falling below zero (when a batch makes
it negative, the step undoes that part instead). Both samples are bounded by
``max_positive`` and ``max_unlabelled``; pi is the share of toxic among labelled
rows that may teach, unless given.

A text's features are its counts over the square root of its number of words,
so neither long nor short texts are favoured.

Defined results: null and empty texts score like a text without features (the
bias alone); without any confirmed toxic text every score is 0; null labels
teach nothing; repeated rows are scored each; an empty table gives an empty
result; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import hash_sample, held_out, map_arrow, raw_texts, slices
from attrition.llm.ngrams import word_features

BITS = 18


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    prior: float


@dataclass
class Rows:
    """Sparse rows: which row, which column, which value; and how many rows."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    @staticmethod
    def of(texts: list[bytes]) -> Rows:
        owner, column, n_words = word_features(texts, BITS)
        key, count = np.unique((owner << BITS) + column, return_counts=True)
        row = key >> BITS
        return Rows(row.astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), (count / np.sqrt(np.maximum(n_words, 1))[row]).astype(np.float32), len(texts))

    def pick(self, starts: np.ndarray, rows: np.ndarray) -> Rows:
        size = starts[rows + 1] - starts[rows]
        at = np.repeat(starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return Rows(np.repeat(np.arange(len(rows), dtype=np.int32), size), self.column[at], self.value[at], len(rows))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk by the margins of the P and the U rows."""
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, un = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if negative < 0:
        return -up, -un
    return up - prior * sigmoid(-zp) / len(zp), un


def calibrate(zu: np.ndarray, prior: float, at_share: float = 0.3, at_middle: float = 0.02) -> tuple[float, float]:
    """Scale and shift from margins of U rows that a model wasn't trained on: the
    margin that the share ``prior`` of them exceeds gets the score ``at_share``,
    their median ``at_middle``."""
    logit = lambda p: float(np.log(p / (1 - p)))
    middle, edge = np.quantile(zu, [0.5, 1 - min(prior, 0.45)])
    scale = (logit(at_share) - logit(at_middle)) / max(float(edge - middle), 1e-6)
    return scale, logit(at_share) - scale * float(edge)


def compact(pos: Rows, unl: Rows, min_rows: int = 5) -> tuple[Rows, Rows, np.ndarray, np.ndarray]:
    """Only columns that ``min_rows`` rows have, renumbered and scaled by rarity (a
    feature that all rows have says little); the columns and their scales."""
    in_rows = np.bincount(pos.column, minlength=1 << BITS) + np.bincount(unl.column, minlength=1 << BITS)
    used = np.flatnonzero(in_rows >= min_rows)
    scale = np.log((pos.n + unl.n + 1) / in_rows[used]).astype(np.float32)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    out = []
    for r in (pos, unl):
        column = number[r.column]
        keep = column >= 0
        out.append(Rows(r.row[keep], column[keep], r.value[keep].astype(np.float32) * scale[column[keep]], r.n))
    return *out, used, scale


def fit(pos: Rows, unl: Rows, prior: float, folds: int = 5, **params) -> Model:
    """The mean of models that each leave out a fold and are calibrated on the U rows of that fold."""
    if not pos.n or not unl.n:
        return Model(np.zeros(1 << BITS, np.float32), -np.inf, prior)
    pos, unl, used, scale = compact(pos, unl)
    starts = [np.searchsorted(r.row, np.arange(r.n + 1)) for r in (pos, unl)]
    if min(pos.n, unl.n) < 2 * folds:
        w, bias = train(pos, unl, starts, [np.arange(pos.n), np.arange(unl.n)], len(used), prior, **params)
    else:
        w, bias = np.zeros(len(used), np.float32), 0.0
        for k in range(folds):
            kept = [np.flatnonzero(np.arange(r.n) % folds != k) for r in (pos, unl)]
            inner, shift = train(pos, unl, starts, kept, len(used), prior, **params)
            left = unl.pick(starts[1], np.flatnonzero(np.arange(unl.n) % folds == k))
            a, b = calibrate(left.times(inner) + shift, prior)
            w += inner * np.float32(a / folds)
            bias += (shift * a + b) / folds
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = w * scale
    return Model(weight, bias, prior)


def train(pos: Rows, unl: Rows, starts: list[np.ndarray], kept: list[np.ndarray], width: int, prior: float, epochs: int = 20, batches: int = 8, rate: float = 0.03, decay: float = 2e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk of the kept rows, with logistic loss."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(width + 1), width
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    w[bias] = np.log(prior / (1 - prior))
    for epoch in range(epochs):
        orders = [np.array_split(rng.permutation(rows), batches) for rows in kept]
        for picks in zip(*orders, strict=True):
            if not all(map(len, picks)):
                continue
            p, u = (r.pick(s, np.sort(k)) for r, s, k in zip((pos, unl), starts, picks, strict=True))
            zp, zu = (r.times(w) + w[bias] for r in (p, u))
            up, un = nn_slopes(zp, zu, prior)
            g = decay * w
            g[bias] = up.sum() + un.sum()
            for r, slope in ((p, up), (u, un)):
                g[:bias] += np.bincount(r.column, r.value * slope[r.row], minlength=bias)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:bias].astype(np.float32), float(w[bias])


def _packed(texts: DataFrame) -> DataFrame:
    """doc_id and the sparse row of each text, as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("columns", pa.binary()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = Rows.of(raw_texts(batch.column("text")))
                cut = np.searchsorted(rows.row, np.arange(rows.n + 1))
                parts = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in (rows.column, rows.value.astype(np.float16))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in parts)], schema=schema)

    return map_arrow(texts.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, columns binary, values binary")


def _stacked(rows: list) -> Rows:
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, r["columns"]))
    column, value = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in (("columns", np.int32), ("values", np.float16)))
    size = [len(r["columns"]) // 4 for r in rows]
    rows.clear()
    return Rows(np.repeat(np.arange(len(size), dtype=np.int32), size), column, value, len(size))


def learn(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 4000, prior: float | None = None, seed: int = 3) -> Model:
    """Fits on at most ``max_positive`` confirmed toxic texts and ``max_unlabelled`` others of rows that may teach."""
    toxic = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        share = toxic.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first().p
        prior = min(max(share or 0.0, 1e-3), 0.45)
    teach = docs.where(~held_out()).select("doc_id", "text")
    found = []
    for ids, n in ((toxic.where("toxic = 1"), max_positive), (teach, max_unlabelled)):
        sample = hash_sample(ids, n, seed)
        found.append(_stacked(_packed(teach.join(F.broadcast(sample), "doc_id")).limit(2 * n).collect()))
    return fit(*found, prior)


def scores(m: Model, texts: list[bytes]) -> np.ndarray:
    owner, column, n_words = word_features(texts, BITS)
    z = np.bincount(owner, m.weight[column], minlength=len(texts)) / np.sqrt(np.maximum(n_words, 1))
    return sigmoid(z + m.bias) if np.isfinite(m.bias) else np.zeros(len(texts))


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                p = scores(shared.value, raw_texts(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_()).cast(pa.int32())], schema=schema)

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, in their own columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array(scores(shared.value, raw_texts(batch.column("text"))) < threshold, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
