"""Ranked lexical search, term at a time with limited accumulators.

The query side (items and their terms) is taken in blocks of bounded size. For a
block, one pass over the texts writes each document's length and its counts of the
block's terms (ids, not words) to the shared folder; a second pass over that table
gives the document frequencies, and a third one ranks.

Ranking goes by shards of documents inside a task. A shard is turned into lists by
term. For each item the terms are taken rarest first; a term's documents get
accumulators until the k-th largest partial score exceeds the sum of the remaining
terms' largest parts, since a document without an accumulator could not reach it any
more. From there on no accumulator is made, and those that exist are completed
exactly. The k-th score of the task's earlier shards counts as well. Each task
returns the k best of each item, and a window ranks those. Results are exact.

Defined results: null and empty texts hold no term; an item without a term, or with
terms that no document has, has no rows; only scores above 0 are ranked; every row
of either table is a document or an item of its own, also where it repeats another;
a null doc_id comes first among equal scores; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import ALNUM, folded_terms, map_arrow, raw_texts, slices
from attrition.session import checkpoint_dir

#: Items, and their distinct terms summed, of a block of the query side (a single
#: longer item is a block of its own).
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 18
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21

_FORWARD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_BEST = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Block:
    """Items of the query side: item_id and term ids of each, and the terms' ids."""

    first: int
    item_ids: list
    items: list[list[int]]
    vocabulary: dict[bytes, int]


def item_terms(text: bytes) -> list[bytes]:
    """The distinct terms of a text, in order."""
    return list(dict.fromkeys(t for terms in folded_terms(text, ALNUM) for t in terms))


def query_blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks; the driver holds one block (and Spark one partition) at a time."""
    block = Block(0, [], [], {})
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        terms = item_terms((row.text or "").encode())
        if block.items and (len(block.items) >= BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
            yield block
            block, size = Block(block.first + len(block.items), [], [], {}), 0
        block.item_ids.append(row.item_id)
        block.items.append([block.vocabulary.setdefault(t, len(block.vocabulary)) for t in terms])
        size += len(terms)
    if block.items:
        yield block


def forward(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n (terms with repeats), terms (ids of the block's terms in it), tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.vocabulary.get
        for whole in batches:
            for batch in slices(whole):
                n, counts = [], []
                for raw in raw_texts(batch.column("text")):
                    count, length = Counter(), 0
                    for terms in folded_terms(raw, ALNUM):
                        length += len(terms)
                        count.update(map(find, terms))
                    del count[None]
                    n.append(length)
                    counts.append(count)
                ends = pa.array(np.append(0, np.cumsum([len(c) for c in counts])).astype(np.int32))
                terms = pa.array([t for c in counts for t in c], pa.int32())
                tf = pa.array([x for c in counts for x in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tf)], schema=_FORWARD)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, terms array<int>, tf array<long>")


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; one counter of the block's size per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    rows = map_arrow(index.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(n_terms, np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L."""
    wide = int(n.max(initial=0)) * n_docs * 50 > 1 << 62
    m = 50 + (np.array([50 * int(x) * n_docs // n_terms for x in n.tolist()], np.int64) if wide else 50 * n * n_docs // max(n_terms, 1))
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard:
    """Lists by term of some documents, which come ordered by doc_id."""

    def __init__(self, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.docs, self.doc, self.part = docs, doc[order], part[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))
        self.most = np.maximum.reduceat(self.part, self.first) if len(order) else self.part
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.scores, self.live = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)

    def best(self, terms: list[int], weight: np.ndarray, df: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of an item, best first, and no
        others than those that can reach ``floor``, the k-th score known so far."""
        here = sorted((int(df[t]), t) for t in terms if t in self.place)
        lists = [self.place[t] for _, t in here]
        bound = [int(weight[t]) * int(self.most[i]) for (_, t), i in zip(here, lists, strict=True)]
        remaining, creating, made = sum(bound), True, []
        for (_, t), i, most in zip(here, lists, bound, strict=True):
            doc, part = self.doc[self.first[i] : self.ends[i]], self.part[self.first[i] : self.ends[i]]
            if creating:
                # a new document could still reach what remains: this term and those behind it
                creating = not self._out_of_reach(made, k, floor, remaining)
            remaining -= most
            if creating:
                new = doc[~self.live[doc]]
                self.live[new] = True
                made.append(new)
            else:
                at = self.live[doc]
                doc, part = doc[at], part[at]
            self.scores[doc] += int(weight[t]) * part
        found = np.concatenate(made) if made else np.zeros(0, np.int64)
        score = self.scores[found]
        self.scores[found], self.live[found] = 0, False
        keep = (score > 0) & (score >= floor)
        found, score = found[keep], score[keep]
        if len(found) > k:
            keep = score >= np.partition(score, -k)[-k]
            found, score = found[keep], score[keep]
        top = np.lexsort((found, -score))[:k]
        return found[top], score[top]

    def _out_of_reach(self, made: list[np.ndarray], k: int, floor: int, remaining: int) -> bool:
        if floor > remaining:
            return True
        n = sum(map(len, made))
        if n < k:
            return False
        partial = self.scores[np.concatenate(made)]
        return int(np.partition(partial, n - k)[n - k]) > remaining


def merge_best(a: tuple, b: tuple, k: int) -> tuple:
    """The k best of two lists of (null first, doc_id, score)."""
    null, doc, score = (np.concatenate(x) for x in zip(a, b, strict=True))
    top = np.lexsort((doc, ~null, -score))[:k]
    return null[top], doc[top], score[top]


def rank(index: DataFrame, shared, k: int) -> DataFrame:
    """item, item_id, doc_id, score: the k best of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, df, weight, n_docs, n_terms = shared.value
        none = (np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best, held, docs, postings = [none] * len(block.items), [], 0, 0

        def search():
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            null, doc_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            lengths = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in held])
            term, tf = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in ("terms", "tf"))
            order = np.lexsort((doc_id, ~null))
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(n)), lengths)
            shard = Shard(order, place[doc], term, saturated(tf, n[doc], n_docs, n_terms))
            for i, terms in enumerate(block.items):
                floor = int(best[i][2][-1]) if len(best[i][2]) == k else 0
                found, score = shard.best(terms, weight, df, k, floor)
                if len(found):
                    at = order[found]
                    best[i] = merge_best(best[i], (null[at], doc_id[at], score), k)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search()
                held, docs, postings = [], 0, 0
        if held:
            search()
        for i, (null, doc, score) in enumerate(best):
            if len(doc):
                fill = [pa.array([x] * len(doc), pa.int64()) for x in (block.first + i, block.item_ids[i])]
                yield pa.RecordBatch.from_arrays([*fill, pa.array(doc, mask=null), pa.array(score)], schema=_BEST)

    return map_arrow(index, run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents with the highest scores for each item."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best_first = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    for b, block in enumerate(query_blocks(items)):
        forward(docs, spark.sparkContext.broadcast(block)).write.option("compression", "zstd").parquet(f"{folder}/index-{b}")
        index = spark.read.parquet(f"{folder}/index-{b}")
        n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(index, len(block.vocabulary))
        shared = spark.sparkContext.broadcast((block, df, weights(df, n_docs), n_docs, n_terms))
        best = rank(index.where(F.size("terms") > 0), shared, k)
        best = best.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        best.select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/best/block={b}")
        found = spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(f"{folder}/best").drop("block")
    return found


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, sum(len(terms))::HUGEINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms)::HUGEINT AS n, unnest(terms) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*)::HUGEINT AS tf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::HUGEINT AS w FROM p, corpus GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
