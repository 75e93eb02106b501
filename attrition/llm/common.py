"""Helpers the operators share: table readers, bounded Arrow slices, the
hash split between learning and held-out rows, hashed words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import attrition
from attrition.session import checkpoint_dir

#: Text bytes that one numpy step handles at a time; bounds a task's memory.
SLICE_BYTES = 1 << 20
#: Largest Arrow batch between Spark and Python.
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if
    they see that folder (else it is installed on them, or sent with --py-files)."""
    root, env = str(Path(attrition.__file__).parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose batches hold at most ``BATCH_BYTES``: Spark's default of
    10,000 rows or 64 MB is a lot for a Python worker when texts are long. Lowers
    the session's setting and never raises it."""
    reach_workers(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m").lower()
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def use_checkpoints(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` write to the shared folder of the session."""
    checkpoint_dir(spark)


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as it takes to differ from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id's text mod 4 is 2.
    A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def hash_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id of at most n documents of ``rows``, by the order of a hash of the
    id; n bounds what a model is fitted on, so the result may be broadcast."""
    return rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``max_bytes`` of text and ``max_rows`` rows each (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // max_bytes + np.arange(len(size)) // max_rows
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def folding(kept: bytes) -> bytes:
    """A table for ``bytes.translate`` that lower-cases A-Z and turns every ASCII
    byte outside ``kept`` into a space; bytes beyond ASCII stay."""
    fold = bytearray(range(256))
    for b in range(128):
        low = bytes([b]).lower()
        fold[b] = low[0] if low in kept else 32
    return bytes(fold)


#: Terms of letters, and of letters and digits; all beyond ASCII counts as a letter.
LETTERS = folding(b"abcdefghijklmnopqrstuvwxyz")
ALNUM = folding(b"abcdefghijklmnopqrstuvwxyz0123456789")


def folded_terms(text: bytes, table: bytes, run: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in lists of about ``run`` bytes, so that a very long
    text never lies in memory as one list of words."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + run)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


#: Odd multipliers of the word hash and of the places of a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``: a polynomial modulo
    2**64 from prefix sums, then mixed with the span's length."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of the lower-cased (A-Z) texts:
    the buffer they lie in, each word's start and end there, and per text the
    position of its first word (one more entry closes the last text)."""
    parts = [t.lower().split() for t in texts]
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    data = np.frombuffer(b" ".join([w for p in parts for w in p]) + b" ", np.uint8)
    end = np.flatnonzero(data == 32) if first[-1] else np.zeros(0, np.int64)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    return data, start, end, first
