"""Language identification with error-correcting output codes.

Each language gets a codeword of +-1; one binary logistic classifier per bit
is trained with numpy on byte n-grams of a bounded sample (``max_rows``, spread
evenly over the languages). Decoding is loss-weighted: the logistic losses of
a text's margins against each codeword are summed, each bit weighted by its
reliability on rows kept back from the sample, and the nearest codeword wins.
A text whose two nearest codewords lie closer than ``min_gap`` is flagged as
ambiguous.

Defined results: null text, and text without a letter, is ``und`` with score 0;
without any language to learn from, so is every text. Null lang teaches
nothing. Ties go to the language that sorts first. Repeated rows are predicted
each; an empty table gives an empty result; lang, source and doc_id are no
inputs of a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import held_out, map_arrow, raw_texts, slices
from attrition.llm.ngrams import LETTERS, byte_ngrams

BITS = 12
SIZES = (1, 2, 3)
UNKNOWN = "und"


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits, +-1
    weight: np.ndarray  # columns + 1 x bits; the last row is the bias
    trust: np.ndarray  # of each bit, sums to 1
    min_gap: float


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Every two-way split of up to seven classes, else random words far apart."""
    if n <= 7:
        bits = [(1, *b) for b in product((1, -1), repeat=n - 1)][1:] or [(1,)]
        return np.ascontiguousarray(np.array(bits, np.float32).T)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    draws = [rng.choice(np.array([-1, 1], np.float32), (n, width)) for _ in range(50)]
    apart = lambda c: (c @ c.T - 2 * width * np.eye(n)).max()
    return min((d for d in draws if (np.abs(d.sum(0)) < n).all()), key=apart, default=draws[0])


def vectors(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram counts, scaled to length 1, with a column of ones."""
    x = np.sqrt(byte_ngrams([t.translate(LETTERS) for t in texts], SIZES, BITS))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def train_bits(x: np.ndarray, y: np.ndarray, steps: int = 60, rate: float = 20.0, decay: float = 1e-5, left_out: np.ndarray | None = None) -> np.ndarray:
    """One logistic classifier per column of y (+-1), both signs weighing the same, by Nesterov
    steps; rows left out weigh nothing (a copy of x without them would double the memory)."""
    used = np.ones((len(y), 1), bool) if left_out is None else ~left_out[:, None]
    share = np.where(y > 0, 0.5 / np.maximum(((y > 0) & used).sum(0), 1), 0.5 / np.maximum(((y < 0) & used).sum(0), 1))
    share = (share * used).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v = w.copy()
    for k in range(steps):
        ahead = w + k / (k + 3) * v
        slope = -y * share / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))  # float32 throughout
        v = ahead - w - rate * (x.T @ slope + decay * ahead)
        w = (w + v).astype(np.float32)
    return w


def fit(x: np.ndarray, labels: list[str], min_gap: float = 0.02) -> Codes:
    """Classifiers and codewords from the vectors of labelled texts."""
    languages = sorted(set(labels))
    if not languages:
        return Codes([], np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32), np.ones(1), min_gap)
    code = codewords(len(languages))
    y = code[np.searchsorted(languages, labels)]
    back = np.arange(len(x)) % 5 == 0
    inner = train_bits(x, y, steps=30, left_out=back) if (~back).any() else np.zeros((x.shape[1], y.shape[1]))
    right = ((x @ inner)[back] * y[back] > 0).mean(0)
    trust = np.maximum(2 * right - 1, 0.05)
    return Codes(languages, code, train_bits(x, y), trust / trust.sum(), min_gap)


def decode(m: Codes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share after softmax, and whether the next one is too near."""
    margin = vectors(texts) @ m.weight
    loss = np.stack([(np.logaddexp(0, -margin * c) * m.trust).sum(1) for c in m.code], 1)
    near = np.sort(loss, 1)
    gap = near[:, 1] - near[:, 0] if near.shape[1] > 1 else np.full(len(near), np.inf)
    share = 1 / np.exp(4 * (near[:, :1] - loss)).sum(1)
    return loss.argmin(1), np.clip(share, 0, 1), gap < m.min_gap


def _packed(texts: DataFrame) -> DataFrame:
    """doc_id, lang and the vector of each text as half-precision bytes, compressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, max_rows=256):
                x = vectors(raw_texts(batch.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], schema=schema)

    return map_arrow(texts.select(F.col("doc_id").cast("long"), "lang", "text"), run, "doc_id long, lang string, x binary")


def learn(docs: DataFrame, max_rows: int = 4000, min_gap: float = 0.02, seed: int = 11, max_languages: int = 64) -> Codes:
    """Fits on at most ``max_rows`` documents that may teach and have text and lang, as
    many of each language, the ``max_languages`` most frequent ones (ties by name);
    others are never predicted. The driver receives vectors, no texts."""
    teach = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in teach.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not counts:
        return fit(np.zeros((0, 1), np.float32), [], min_gap)
    each = max(1, max_rows // len(counts))
    # a hash lets about 2 * each + 100 rows of a language through, however many it has; the window takes the first
    odds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (2 * each + 100) / n) * 2**40))])
    some = teach.where(F.col("lang").isin(list(counts)) & (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2**40)) < F.element_at(odds, F.col("lang"))))
    by_hash = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = some.select("lang", "doc_id").distinct().withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= each)
    # at most max_rows ids
    rows = _packed(some.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")).limit(2 * max_rows).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 2**32, r.x, r.lang))
    labels = [r.lang for r in rows]
    x = np.empty((len(rows), (1 << BITS) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(r.x), np.float16)
    del rows
    return fit(x, labels, min_gap)


def has_letter(texts: list[bytes]) -> list[bool]:
    return [any(map(str.isalpha, t.decode())) for t in texts]


def identify(m: Codes, texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and ambiguity of each text."""
    if not m.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    spoken = has_letter(texts)
    best, share, flag = decode(m, texts)
    return (
        [m.languages[b] if s else UNKNOWN for b, s in zip(best, spoken, strict=True)],
        [float(p) if s else 0.0 for p, s in zip(share, spoken, strict=True)],
        [bool(a) and s for a, s in zip(flag, spoken, strict=True)],
    )


def predict(docs: DataFrame, model: Codes) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, max_rows=256):
                found = identify(shared.value, raw_texts(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(found, schema.types[2:], strict=True))], schema=schema)

    return map_arrow(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Codes) -> DataFrame:
    """The documents, in their own columns, whose language is known and not ambiguous;
    where no language could be learned, those that have a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, max_rows=256):
                texts = raw_texts(batch.column("text"))
                lang, _, unsure = identify(shared.value, texts)
                stay = [x != UNKNOWN and not u for x, u in zip(lang, unsure, strict=True)] if shared.value.languages else has_letter(texts)
                yield batch.filter(pa.array(stay, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
