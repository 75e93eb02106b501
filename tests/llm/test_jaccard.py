import random

import numpy as np

import corpus_pipeline
from attrition.llm import jaccard
from oracle.compare import compare
from tests.llm.conftest import ODD_TEXTS

WORDS = ["w%d" % i for i in range(3000)]


def near_copies(seed=1, groups=6, size=25):
    """Groups of near copies at and about the threshold, exact copies, and a passage that many share."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(40)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.choice([8, 30, 90, 300]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.2:
                w = w[: max(5, int(len(w) * 0.8))]
            rows.append((doc, rng.choice([" ", "  ", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
            doc += 1
        rows += [(doc + k, rows[-1][1]) for k in range(3)]
        doc += 3
    for _ in range(60):
        own = [rng.choice(WORDS) for _ in range(rng.choice([10, 60, 200]))]
        rows.append((doc, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
        doc += 1
    return rows


def test_equals_brute_force(make_docs, monkeypatch):
    rows = near_copies() + [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs, _, con = make_docs(rows)
    r = compare(jaccard.similar_groups(docs), con, jaccard.GROUPS_SQL)
    assert r["values_match"], r
    monkeypatch.setattr(jaccard, "TILE", 4)  # hot tokens spread over many tiles
    r = compare(jaccard.similar_groups(docs), con, jaccard.GROUPS_SQL)
    assert r["values_match"], r


def test_links_exactly_at_the_threshold(make_docs):
    """6 of 8 shingles shared is 75 of 100; 5 of 9 isn't."""
    a = "a b c d e f g h i j k"  # 7 shingles
    rows = [(1, a), (2, "a b c d e f g h i j z"), (3, a + " l"), (4, "q " + a + " l")]
    docs, _, con = make_docs(rows)
    r = compare(jaccard.similar_groups(docs), con, jaccard.GROUPS_SQL)
    assert r["values_match"], r


def test_null_ids_repeated_rows_empty_table_and_representatives(make_docs):
    text = " ".join(WORDS[:50])
    rows = [(3, text), (3, text), (None, text), (9, text + " tail"), (9, "quite another text with more than five words"), (4, None), (4, ""), (None, "alone here without any partner at all")]
    docs, _, _ = make_docs(rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.similar_groups(docs).collect())
    assert got == sorted([(3, 46, 3), (3, 46, 3), (-1, 46, 3), (9, 47, 3), (9, 4, 9), (4, 0, 4), (4, 0, 4), (-1, 3, -1)])
    kept = jaccard.first_of_groups(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 3, 3, 4, 4]
    assert jaccard.similar_groups(docs.limit(0)).collect() == []


def test_the_pipeline_keeps_one_document_of_each_group_and_every_other_text(make_docs, spark):
    text, other = " ".join(WORDS[:50]), "quite another text with more than five words"
    nameless = " ".join(WORDS[100:150])
    rows = [(3, text), (3, text), (None, text), (9, text + " tail"), (9, other), (4, None), (4, ""), (None, nameless), (None, nameless), (None, "alone here"), (7, text)]
    docs, _, _ = make_docs(rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, text), (9, other), (4, None), (4, ""), (None, nameless), (None, "alone here")]))
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").collect() == []


def test_classes_of_null_ids_link_others(make_docs):
    """The middle text, which links the two others, has no id."""
    w = WORDS[:60]
    a, b, c = (" ".join(x) for x in (w, w[7:] + ["x1"], w[13:] + ["x1", "x2"]))
    docs, _, _ = make_docs([(5, a), (None, b), (8, c)])
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    assert got == {5: 5, None: 5, 8: 5}


def test_prefix_filters_keep_every_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(4, 200))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.92], rng.integers(0, 2**63, n // 20).astype(np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        similar = 100 * both >= 75 * (len(x) + len(y) - both)
        assert jaccard._linked(x, y, 75) == similar
        if similar:
            px, py = (set(s[: jaccard.prefix_length(len(s), 75, jaccard.least_shared(len(s), 0.1))]) for s in (x, y))
            for s in (x, y):
                assert len(px & py) >= jaccard.least_shared(-(-75 * len(s) // 100), 0.1)
            parity = [jaccard.parity_bits(s) for s in (x, y)]
            assert jaccard._close(parity, np.array([len(x), len(y)]), np.array([0]), np.array([1]), 75).all()
