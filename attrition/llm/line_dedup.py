"""Line dedup: lines that many documents share stay in one document only.

Hashes of the lines' keys are range-partitioned with a secondary sort by
document (largest first), so each partition is streamed once and a key's
first row is the document that keeps its lines. The range bounds include the
document, hence a key held by a third of all documents spreads over many
partitions; a key that crosses a border between partitions is settled from
one summary row per partition. What comes back are compressed keep bitmaps
per document, never text.

Defined results: null or empty text is one empty line; a null doc_id is a
document of its own, smaller than every other; rows that repeat a doc_id are
one document for the count and each keeps or drops its own lines; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import fresh, map_arrow, slices, use_checkpoints

WHITE = " \t\n\x0b\x0c\r"
NO_DOC = -(1 << 63)

_OCC = "h1 long, h2 long, doc long, row_key long, n_lines int, lines array<int>"
_RUN = "kind int, h1 long, h2 long, doc long, row_key long, n_lines int, lines array<int>, n_docs long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _occurrences(min_points: int):
    schema = _arrow(_OCC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows: list[tuple] = []
                for doc, row_key, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "row_key", "text")), strict=True):
                    lines, found = split_lines(text), {}
                    for i, line in enumerate(lines):
                        if len(line) >= min_points and len(key := line.strip(WHITE)) >= min_points:
                            found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
                    rows += [(h, doc, row_key, len(lines), at) for h, at in found.items()]
                if rows:
                    h, doc, row_key, n, at = zip(*rows, strict=True)
                    h = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h[:, 0], h[:, 1], doc, row_key, n, at), schema.types, strict=True)], schema=schema)

    return run


def _stream(min_docs: int):
    """Walks a partition sorted by key, then document from the largest.
    Kinds of rows out: 0 these lines go; 1 undecided, since the key may lie in
    other partitions too; 2 what this partition holds of such a key."""
    schema = _arrow(_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = top = last = None
        n_docs, border, waiting, out = 0, True, [], []

        def packed() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for h1, h2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != key:
                    if key and border:
                        out.append((2, *key, top, None, None, None, n_docs))
                    key, border = (h1, h2), key is None
                    top, last, n_docs, waiting = row[0], None, 0, []
                n_docs += row[0] != last
                last = row[0]
                if border:
                    out.append((1, *key, *row, None))
                elif n_docs < min_docs:
                    waiting.append(row)
                else:
                    out += [(0, *key, *x, None) for x in (*waiting, row) if x[0] != top]
                    waiting = []
            if out:
                yield packed()
                out = []
        if key:
            out += [(1, *key, *x, None) for x in waiting]
            out.append((2, *key, top, None, None, None, n_docs))
            yield packed()

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed bit per line, 1 where it stays."""
    schema = _arrow("doc long, row_key long, n_lines int, n_dropped int, keep binary")
    for batch in batches:
        doc, row_key, n_lines, lines = (batch.column(c) for c in ("doc", "row_key", "n_lines", "lines"))
        maps, dropped = [], []
        for n, at in zip(n_lines.to_pylist(), lines.to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([doc, row_key, n_lines, pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], schema=schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id, null as the smallest; row_key tells apart rows that repeat an id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), F.xxhash64("text").alias("row_key"), "text")


def keep_bitmaps(docs: DataFrame, min_points: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, row_key, n_lines, n_dropped, keep) for the documents that lose lines."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    occ = map_arrow(_keyed(docs), _occurrences(min_points), _OCC)
    order = ["h1", "h2", F.col("doc").desc()]
    runs = map_arrow(occ.repartitionByRange(parts, *order).sortWithinPartitions(*order), _stream(min_docs), _RUN).checkpoint()
    totals = runs.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    # at most two rows for each partition of the sort: small by construction
    undecided = runs.where("kind = 1").join(F.broadcast(totals), ["h1", "h2"]).where("doc <> top")
    cols = ["doc", "row_key", "n_lines", "lines"]
    gone = runs.where("kind = 0").select(*cols).unionByName(undecided.select(*cols))
    per_doc = gone.groupBy("doc", "row_key").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("lines"))
    return map_arrow(per_doc, _bitmap, "doc long, row_key long, n_lines int, n_dropped int, keep binary")


def kept_text(text: str | None, n_lines: int | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines; lines before; lines dropped."""
    lines = split_lines(text)
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join([x for x, k in zip(lines, bits.tolist(), strict=True) if k]), len(lines), int(n_lines - bits.sum())


def with_bitmaps(docs: DataFrame, **params) -> tuple[DataFrame, str, str]:
    """The documents' columns and two more, whose names come back too: the number
    of lines and the keep bitmap (null: all lines stay)."""
    names = [fresh(n, docs.columns) for n in ("keep_lines", "keep", "doc_key", "text_key", "map_doc", "map_key")]
    lines, keep, doc, key, map_doc, map_key = names
    maps = keep_bitmaps(docs, **params).select(F.col("doc").alias(map_doc), F.col("row_key").alias(map_key), F.col("n_lines").alias(lines), F.col("keep").alias(keep))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)), key: F.xxhash64("text")})
    joined = keyed.join(maps, (F.col(doc) == F.col(map_doc)) & (F.col(key) == F.col(map_key)), "left")
    return joined.drop(doc, key, map_doc, map_key), lines, keep


def line_digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    joined, lines, keep = with_bitmaps(docs.select("doc_id", "text"), **params)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                kept = [kept_text(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("text", lines, keep)), strict=True)]
                digests = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in kept]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n, _ in kept], pa.int64()), pa.array([n for _, _, n in kept], pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return map_arrow(joined, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_shared_lines(docs: DataFrame, **params) -> DataFrame:
    """The documents, in their own columns, without the lines that go; n_chars follows the text."""
    schema = docs.schema
    joined, lines, keep = with_bitmaps(docs, **params)

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                new = [None if t is None else kept_text(t, n, k)[0] for t, n, k in zip(*(batch.column(c).to_pylist() for c in ("text", lines, keep)), strict=True)]
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field("text"), pa.array(new, batch.schema.field("text").type)).select(schema.names)

    out = map_arrow(joined, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key FROM (
    SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS line,
           translate(regexp_replace(unnest(parts), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (SELECT lower_key, max(doc_id) AS top FROM lines WHERE length(lower_key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, s.top IS NOT NULL AND s.top <> l.doc_id AS gone FROM lines l LEFT JOIN shared s USING (lower_key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
