"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Texts become weighted byte n-gram vectors (A-Z and punctuation kept, plus how
often a word repeats the one before it); a truncated SVD of a bounded sample
(``max_fit`` rows) gives the latent space. The vectors of at most
``max_labelled`` labelled rows that may teach are broadcast; every document is
compared with all of them by exact blocked cosine products, and its
``n_neighbours`` nearest vote with weights that grow with similarity.

Defined results: null and empty texts, having no neighbours, get the labels'
mean; without any label every score is 0; null labels teach nothing; a doc_id
labelled twice counts with its smallest label; repeated rows are scored each;
similarities are compared in steps of 2^-16, and ties between neighbours go to the
smaller doc_id; an empty table gives an empty
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
from attrition.llm.ngrams import byte_ngrams

BITS = 11
SIZES = (1, 2, 3)
#: Steps of a similarity: equal texts tie, whatever the rounding of a product.
TIE = 1 << 16


@dataclass
class Space:
    """From n-gram counts to the latent space."""

    idf: np.ndarray
    basis: np.ndarray


@dataclass
class Model:
    space: Space
    vectors: np.ndarray  # labelled rows x dimensions, of length 1, by doc_id
    labels: np.ndarray
    n_neighbours: int
    power: float


def repeats(texts: list[bytes]) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    out = np.zeros(len(texts), np.float32)
    for i, t in enumerate(texts):
        w = t.split()
        if len(w) > 1:
            out[i] = sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram shares, and that of repeated words."""
    x = byte_ngrams(texts, SIZES, BITS)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    return np.hstack([x, np.sqrt(repeats(texts))[:, None]])


def fit_space(x: np.ndarray, dimensions: int = 48, seed: int = 9) -> Space:
    """Randomised truncated SVD of the rows, columns weighted by rarity."""
    idf = (1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))).astype(np.float32)
    idf[-1] = 2
    y = x * idf
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(y.T @ rng.standard_normal((len(y), dimensions + 16)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    _, _, vt = np.linalg.svd(y @ q, full_matrices=False)
    return Space(idf, (q @ vt.T[:, :dimensions]).astype(np.float32))


def project(s: Space, x: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 (zero for rows without features)."""
    z = (x * s.idf) @ s.basis
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def vote(m: Model, z: np.ndarray, block: int = 128) -> np.ndarray:
    """Similarity-weighted mean label of each row's nearest labelled vectors."""
    if not len(m.labels):
        return np.zeros(len(z))
    out, base, k = np.empty(len(z)), float(m.labels.mean()), min(m.n_neighbours, len(m.labels))
    for at in range(0, len(z), block):
        cosine = z[at : at + block] @ m.vectors.T
        step = np.rint(cosine * TIE)
        kth = np.partition(step, -k, axis=1)[:, [-k]]
        chosen, tied = step > kth, step == kth
        places = k - chosen.sum(1, keepdims=True)
        cut = np.flatnonzero(tied.sum(1) > places[:, 0])
        tied[cut] &= np.cumsum(tied[cut], axis=1) <= places[cut]
        near = np.nonzero(chosen | tied)[1].reshape(len(cosine), k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** m.power
        total = weight.sum(1)
        out[at : at + block] = np.where(total > 1e-9, (weight * m.labels[near]).sum(1) / np.maximum(total, 1e-9), base)
    return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_fit: int = 2500, dimensions: int = 48, n_neighbours: int = 15, power: float = 8.0, seed: int = 4) -> Model:
    """Fits the space and the labelled vectors on bounded samples of rows that may teach."""
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hash_sample(known, max_labelled, seed).join(known, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, max_rows=256):
                x = features(raw_texts(batch.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

    texts = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    rows = map_arrow(texts, run, "doc_id long, quality int, x binary").limit(2 * max_labelled).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.doc_id, r.x))
    width = (1 << BITS) + 1
    x = np.frombuffer(b"".join(r.x for r in rows), np.float16).reshape(-1, width)
    y = np.array([r.quality for r in rows], np.float64)
    if not len(x):
        return Model(Space(np.ones(width, np.float32), np.zeros((width, 1), np.float32)), np.zeros((0, 1), np.float32), y, n_neighbours, power)
    space = fit_space(x[:max_fit].astype(np.float32), min(dimensions, len(x)))
    z = np.vstack([project(space, x[a : a + 1000].astype(np.float32)) for a in range(0, len(x), 1000)])
    by_id = np.argsort(np.array([r.doc_id for r in rows]), kind="stable")
    return Model(space, z.astype(np.float32)[by_id], y[by_id], n_neighbours, power)


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, max_rows=256):
                p = vote(shared.value, project(shared.value.space, features(raw_texts(batch.column("text")))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_()).cast(pa.int32())], schema=schema)

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
