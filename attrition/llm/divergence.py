"""Divergence audit: how far each source of a language strays from its peers.

Terms are counted in the tasks that read the texts and merged by (lang, term).
The kept terms form a term-major index: one row for each (lang, term) with the
sources that use it. Pair values are sums of f(p, q) over all kept terms, so also
over terms that one or both sources lack. They are accumulated row by row: each
source scatters its terms through the index into one dense row of sums, a place
for each peer, and no pair of postings leaves a task. A scattered term counts as
if it were absent in its other pairs, so what is added is

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

where p0, q0 are the shares of an absent term (the zero baseline). The baselines
are then put right with one dense row per source made from the histogram of its
shares: V f(p0, q0) plus, for each of its terms, f(p, q0) - f(p0, q0), once for
it as the row and once as the peer.

A task holds a block of at most ``CELLS`` sums; the index is dealt out by block of
rows and by hash of the term. The row of one source (its peers) and the postings
of one term are as long as a language has sources; the result has a row for each
pair of them.

All arithmetic is on integers: counts up to 9 x 10^18, shares by decimal division.
Defined results: null text, lang and source are empty; groups without terms and
languages without kept terms have pairs of value 0 (V = 0) or of baselines; ties
go by the item's bytes; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import LETTERS, folded_terms, map_arrow, raw_texts, slices
from attrition.session import checkpoint_dir

#: (group, term) counts that a task gathers before it hands them on.
HELD = 1 << 17
#: Pair sums of one task.
CELLS = 1 << 20
#: Terms of a language for each task that scatters them, at least.
TERMS_PER_SLICE = 1024

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_DENSE = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("sums", pa.list_(pa.int64()))])
_BASE = pa.schema([*_DENSE, ("mirrored", pa.list_(pa.int64()))])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term), whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def rows():
            for (lang, source), (n, d) in groups.items():
                terms = list(n)
                for a in range(0, len(terms), 1 << 15):
                    part = terms[a : a + (1 << 15)]
                    fill = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*fill, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], schema=_COUNTS)

        for whole in batches:
            for batch in slices(whole):
                for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw_texts(batch.column("text")), strict=True):
                    n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                    before, distinct = len(n), set()
                    for terms in folded_terms(raw, LETTERS):
                        n.update(terms)
                        distinct.update(terms)
                    d.update(distinct)
                    held += len(n) - before
                    if held >= HELD:
                        yield from rows()
                        groups, held = {}, 0
        yield from rows()

    raw = map_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term), so that the sums of a term's sources and of the term need no further shuffle
    return raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares."""
    return (p - q) * (p - q) // (p + q)


def scatter(offsets: np.ndarray, peer: np.ndarray, p: np.ndarray, p0: np.ndarray, sums: np.ndarray, low: int) -> None:
    """Adds the terms of an index (CSR: ``offsets`` into the postings) to the rows
    of sums of the sources low, low + 1, ...: each source's own postings lead to
    the postings of the same terms, whose peers are places in its row."""
    term = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    mine = np.flatnonzero((peer >= low) & (peer < low + len(sums)))
    mine = mine[np.argsort(peer[mine], kind="stable")]
    for own in np.split(mine, np.flatnonzero(np.diff(peer[mine])) + 1):
        if not len(own):
            continue
        first, n = offsets[term[own]], offsets[term[own] + 1] - offsets[term[own]]
        other = np.arange(n.sum()) + np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n)
        x, x0 = np.repeat(p[own], n), p0[own[0]]
        y, y0 = p[other], p0[other]
        np.add.at(sums[peer[own[0]] - low], peer[other], divergence(x, y) - divergence(x, y0) - divergence(x0, y) + divergence(x0, y0))


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _scattered(blocks: DataFrame) -> DataFrame:
    """lang, a, sums: dense rows, one for each source and task that saw it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def rows():
            for k in np.flatnonzero(sums.any(1)) if sums is not None else ():
                yield pa.RecordBatch.from_pylist([{"lang": at[0], "a": at[1] + int(k), "sums": sums[k]}], schema=_DENSE)

        for whole in batches:
            keys = list(zip(whole.column("lang").to_pylist(), whole.column("low").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                if keys[a] != at:
                    yield from rows()
                    at, size = keys[a], batch.column("size")[0].as_py()
                    sums = np.zeros((min(batch.column("height")[0].as_py(), size - at[1]), size), np.int64)
                lists = batch.column("postings")
                flat = lists.flatten()
                offsets = np.append(0, np.cumsum(_ints(lists.value_lengths())))
                scatter(offsets, _ints(flat.field("idx")), _ints(flat.field("p")), _ints(flat.field("p0")), sums, at[1])
        yield from rows()

    return map_arrow(blocks, run, "lang string, a int, sums array<long>")


def _baselines(rows: DataFrame) -> DataFrame:
    """lang, a, sums, mirrored: what a source's row and its column lack after the scatter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q0 = np.array(r["peers"], np.int64)
                absent = divergence(np.full(len(q0), r["p0"], np.int64), q0)
                add = np.zeros(len(q0), np.int64)
                for h in r["histogram"] or ():
                    add += h["n"] * (divergence(np.full(len(q0), h["p"], np.int64), q0) - absent)
                yield pa.RecordBatch.from_pylist([{"lang": r["lang"], "a": r["idx"], "sums": add + r["kept"] * absent, "mirrored": add}], schema=_BASE)

    return map_arrow(rows, run, "lang string, a int, sums array<long>, mirrored array<long>")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair': every other source of the language; 'term': the
    ``top`` terms that the source uses more than its language), item, value, rank."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/divergence-{uuid.uuid4().hex}"
    docs = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("postings"))
    by_term.where(F.col("docs") >= min_docs).drop("docs").write.parquet(folder)
    index = spark.read.parquet(folder)

    flat = index.select("lang", "term", "all", F.inline("postings"))
    used = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("whole"))
    groups = docs.select("lang", "source").distinct().withColumn("idx", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.join(used, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept", "whole"])
    share_ = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(1))
    groups = groups.withColumn("p0", share_).checkpoint()

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("whole"), F.col("kept"))
    postings = flat.join(groups, ["lang", "source"]).select("lang", "source", "term", "idx", "p0", "kept", p.alias("p"), q.alias("q"))

    first = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = more.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("idx", "p0"))).alias("peers"))
    langs = langs.select("lang", "size", F.col("peers.p0").alias("peers"), F.expr(f"greatest(1, {CELLS} div size)").alias("height"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_ = F.pmod(F.xxhash64("term"), F.expr(f"least({parts}, kept div {TERMS_PER_SLICE} + 1)"))
    blocks = postings.groupBy("lang", "term", "kept").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("postings")).join(langs.drop("peers"), "lang")
    blocks = blocks.withColumn("low", F.explode(F.expr("array_distinct(transform(postings, x -> x.idx div height * height))"))).withColumn("slice", slice_)
    blocks = blocks.repartition("lang", "low", "slice").sortWithinPartitions("lang", "low").select("lang", "low", "size", "height", "postings")

    shares = postings.groupBy("lang", "idx", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "idx").agg(F.collect_list(F.struct("p", "n")).alias("histogram"))
    rows = groups.select("lang", "idx", "p0", "kept").join(shares, ["lang", "idx"], "left").join(langs.select("lang", "peers"), "lang")

    base = _baselines(rows).checkpoint()
    ab = base.select("lang", "a", F.posexplode("sums").alias("b", "v"))
    ba = base.select("lang", F.col("a").alias("b_"), F.posexplode("mirrored").alias("a_", "v")).select("lang", F.col("a_").alias("a"), F.col("b_").alias("b"), "v")
    both = _scattered(blocks).select("lang", "a", F.posexplode("sums").alias("b", "v"))
    sums = both.unionByName(ab).unionByName(ba).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    name = lambda idx, as_: groups.select("lang", F.col("idx").alias(idx), F.col("source").alias(as_))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    return pairs.unionByName(terms)


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(total.total, 0) + 2 * v.kept) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 2) // (v.total + 2 * v.kept) AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms)
WHERE rank <= 10
"""
