import hashlib
import random

from attrition.llm import line_dedup
from oracle.compare import compare
from tests.llm.conftest import ODD_TEXTS

LONG = "the quick brown fox jumps over the lazy dog %d"


def rows_with_shared_lines(n=120):
    rng = random.Random(4)
    shared = [LONG % i for i in range(8)]
    out = []
    for doc in range(n):
        lines = ["own line of document %d that nobody else has, at all %d" % (doc, k) for k in range(rng.randint(0, 3))]
        lines += [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + " " for x in shared if rng.random() < 0.5]
        lines += [shared[0]] * rng.randint(0, 3) + ["short"] + ["held by four documents only, never by a fifth one"] * (doc < 4)
        rng.shuffle(lines)
        out.append((doc, "\n".join(lines)))
    return out


def test_matches_sql_with_a_key_that_spans_partitions(spark, make_docs):
    rows = rows_with_shared_lines() + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs, _, con = make_docs(rows)
    r = compare(line_dedup.line_digest(docs), con, line_dedup.LINES_SQL)
    assert r["values_match"] and r["spark_rows"] == len(rows), r


def test_stages_of_the_stream_agree_for_any_number_of_partitions(spark, make_docs):
    docs, _, _ = make_docs(rows_with_shared_lines())
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.add(tuple(sorted(map(tuple, line_dedup.line_digest(docs).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_repeated_rows_null_ids_and_clashing_columns(spark, make_docs):
    line = LONG % 1
    rows = [(i, line) for i in range(5)] + [(4, line), (4, line + "\nmore"), (None, line), (None, line)]
    docs, _, _ = make_docs(rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped) for r in line_dedup.line_digest(docs).collect())
    assert got == [(-1, 1, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 0), (4, 1, 0), (4, 2, 0)]
    kept = line_dedup.drop_shared_lines(docs)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_chars, r.keep) for r in kept.collect())
    assert texts[0] == (-1, "", 0, "x") and texts[-1] == (4, line + "\nmore", len(line) + 5, "x")


def test_null_text_stays_null_and_empty_table_is_empty(spark, make_docs):
    docs, _, _ = make_docs([(1, None), (2, "a")])
    assert {(r.doc_id, r.text) for r in line_dedup.drop_shared_lines(docs).collect()} == {(1, None), (2, "a")}
    digest = {r.doc_id: r for r in line_dedup.line_digest(docs).collect()}
    assert digest[1].n_lines == 1 and digest[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert line_dedup.line_digest(docs.limit(0)).collect() == []
