"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector that is projected to a few
dimensions; the vector's place on a Hilbert curve is the sort key. Documents
are range-sorted by that key, so that neighbours on the curve share sequences,
and laid end to end: a document is cut only where a sequence is full, and no
place is left empty but at the end of the last sequence. Only keys and lengths
are sorted; ids move once, to the join with their place in the stream.

Token ids are those of a byte-level BPE vocabulary file of the ``tokenizers``
library, computed with ``tiktoken`` from the ranks in that file (the same ids,
four times faster; tests compare the two). As in that library, a text is split at
the file's added tokens (``<|endoftext|>``), which become their own ids.

Defined results: null and empty texts have the end id alone; repeated rows and
null doc_ids are documents of their own; ties on the curve go by doc_id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, mix, slices
from attrition.session import checkpoint_dir

#: Fixed value: how byte-level BPE of this kind splits a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 0


@dataclass
class Vocabulary:
    """Bytes of each mergeable id, which follow merge order, and ids of the added tokens."""

    ranks: dict[bytes, int]
    added: dict[str, int]

    @property
    def size(self) -> int:
        """The smallest id above all others."""
        return max([*self.ranks.values(), *self.added.values()], default=-1) + 1

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens=self.added)


def token_ids(coder, text: str) -> list[int]:
    """Ids of the text, added tokens in it included."""
    return coder.encode(text, allowed_special="all", disallowed_special=())


def load(path: str) -> Vocabulary:
    """Reads a byte-level BPE file; refuses one whose ids don't follow its merges, that
    normalizes texts, or whose added tokens have flags or contain one another."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if spec["normalizer"] or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("normalizers and added tokens with flags are not supported")
    if any(a != b and a in b for a in added for b in added):
        raise ValueError("added tokens that contain one another are not supported")
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made) or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("only byte-level BPE files whose ids follow the merges are supported")
    return Vocabulary({bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}, added)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows x dimensions), each coordinate below 2**bits."""
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the rotations, from the largest cube down
        q = one << np.uint64(level)
        low = q - one
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_keys(ids: list[np.ndarray], width: int = 256, dimensions: int = 3, bits: int = 16, seed: int = 2) -> np.ndarray:
    """Hilbert keys of the hashed, projected vectors of token ids."""
    axes = np.random.default_rng(seed).standard_normal((width, dimensions))
    axes = np.linalg.qr(axes)[0]
    x = np.stack([np.bincount((mix(i.astype(np.uint64)) % np.uint64(width)).astype(np.int64), minlength=width) for i in ids])
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return hilbert(np.clip(((x @ axes + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def tokenized(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, key, n_tokens, ids (little-endian, END_ID last; 2 bytes each while the vocabulary allows)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = id_type(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.encoding()
        for whole in batches:
            for batch in slices(whole, max_rows=2048):
                ids = [np.array([*token_ids(coder, t or ""), END_ID], width) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(curve_keys(ids)), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, key long, n_tokens long, ids binary")


def id_type(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.size <= 1 << 16 else "<u4"


def stream_offsets(rows: DataFrame) -> DataFrame:
    """(row, first): tokens before each row in the order of key, doc_id and row."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "doc_id", "row"]
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            end = before + np.cumsum(n)
            before = int(end[-1]) if len(end) else before
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(end - n), batch.column("n_tokens")], schema=schema)

    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "row", "n_tokens")
    local = map_arrow(sorted_, run, "part int, row long, local long, n_tokens long").checkpoint()
    # one row for each partition of the sort: small by construction
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return local.join(F.broadcast(starts), "part").select("row", (F.col("base") + F.col("local")).alias("first"))


def pack(docs: DataFrame, vocabulary: Vocabulary, size: int = 1024, digest: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids (or ids_crc32), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    tokenized(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)
    placed = tokens.select("row", "doc_id", "ids").join(stream_offsets(tokens.select("key", "doc_id", "row", "n_tokens")), "row")
    width = id_type(vocabulary)
    field = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), field, ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, all_ids = [], []
            for doc, raw, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "first")), strict=True):
                ids = np.frombuffer(raw, width).astype("<u4")
                all_ids.append(ids)
                cuts = [0, *range(size - first % size, len(ids), size), len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    rows.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()) if digest else None, len(ids), (first + a) // size, (first + a) % size))
            doc, start, length, crc, *rest = zip(*rows, strict=True)
            ends = np.append(0, np.cumsum(length)).astype(np.int32)
            payload = pa.array(crc, pa.int64()) if digest else pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, start, length)), payload, *(pa.array(c, pa.int64()) for c in rest)], schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return map_arrow(placed, run, f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long")
