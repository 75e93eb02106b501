import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from attrition.llm import ranked
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=50):
    """(item place, doc_id, score), scored one by one with Python integers."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for i, (_, text) in enumerate(items):
        scored = []
        for d, c in held:
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(items[i][0], r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def tables(spark, tmp_path, make_docs):
    def make(docs, items):
        table, folder, con = make_docs(docs)
        spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, term string").write.parquet(f"{folder}/benchmark.parquet")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{folder}/benchmark.parquet/*.parquet')")
        return table, spark.read.parquet(f"{folder}/benchmark.parquet"), con

    return make


def corpus(rng, n, words, skew=1.0):
    weights = [1 / (i + 1) ** skew for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]


def test_search_equals_sql_and_brute_force(tables, monkeypatch):
    rng = random.Random(1)
    words = [f"W{i}" for i in range(80)] + ["éa", "的文", "x9"]
    docs = corpus(rng, 300, words) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(2000 + i, "w1 w2 copies of one text") for i in range(120)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 30)) * 2)) for i in range(25)] + [(90, None), (91, ""), (92, "unknownword"), (93, "w1 COPIES"), (94, "a b")]
    monkeypatch.setattr(ranked, "SHARD_DOCS", 40)
    table, benchmark, con = tables(docs, items)
    got = sorted((tuple(r) for r in ranked.search(table, benchmark).collect()), key=str)
    assert got == sorted(con.execute(ranked.SEARCH_SQL).fetchall(), key=str) == brute(docs, items)


def test_repeated_rows_null_ids_and_blocks_of_items(tables, monkeypatch):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(30)]
    docs = corpus(rng, 60, words) + [(7, "t1 t2"), (7, "t1 t2"), (None, "t1 t2 t3"), (None, "t1 t2 t3")]
    items = [(i % 5, " ".join(rng.sample(words, 6))) for i in range(12)] + [(None, "t1")]
    table, benchmark, _ = tables(docs, items)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 20)
    got = sorted((tuple(r) for r in ranked.search(table, benchmark, 9).collect()), key=str)
    assert got == brute(docs, items, 9)


def test_accumulators_stop_and_the_result_is_whole():
    """Random lists with skewed weights: the k best equal full scoring, though
    accumulators are made for part of the documents only."""
    rng, made = np.random.default_rng(3), []
    for _ in range(60):
        n, v = 400, 12
        df = np.sort(rng.integers(3, n, v))
        term = np.repeat(np.arange(v), df)
        doc = np.concatenate([np.sort(rng.choice(n, d, replace=False)) for d in df])
        part = rng.integers(1, 50, len(doc))
        weight = ranked.weights(df, n)
        shard = ranked.Shard(np.arange(n), doc, term, part)
        full = np.zeros(n, np.int64)
        np.add.at(full, doc, weight[term] * part)
        order = np.lexsort((np.arange(n), -full))
        order = order[full[order] > 0]
        seen = shard._out_of_reach
        stops = []
        shard._out_of_reach = lambda *a, seen=seen, stops=stops: stops.append(seen(*a)) or stops[-1]
        for k, floor in ((5, 0), (5, int(full[order[4]])), (50, 0)):
            found, score = shard.best(list(range(v)), weight, df, k, floor)
            assert found.tolist() == order[:k].tolist() and score.tolist() == full[order[:k]].tolist()
        made.append(any(stops))
        assert not shard.live.any() and not shard.scores.any()
    assert sum(made) > 30


def test_terms_of_very_long_texts():
    from attrition.llm.common import ALNUM, folded_terms

    text = ("Word1 ...  éX " * 5000 + "y" * 3000 + " end").encode()
    runs = list(folded_terms(text, ALNUM, run=1000))
    assert len(runs) > 20 and [t.decode() for r in runs for t in r] == terms(text.decode())


def test_empty_tables(tables):
    table, benchmark, _ = tables([(1, "x")], [(1, "x")])
    assert ranked.search(table.limit(0), benchmark).collect() == []
    assert ranked.search(table, benchmark.limit(0)).collect() == []
    assert ranked.search(table, benchmark).count() == 1
