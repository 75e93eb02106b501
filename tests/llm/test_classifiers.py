import math
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import language, quality, toxicity
from tests.llm.conftest import ODD_TEXTS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_codewords_tell_classes_apart():
    assert language.codewords(4).shape == (4, 7)
    for n in (1, 2, 3, 5, 12, 40):
        code = language.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n and set(np.unique(code)) <= {-1.0, 1.0}


def test_language_accuracy_on_held_out_rows(docs):
    found = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_edge_rows(spark, make_docs, docs):
    model = language.learn(docs)
    odd, _, _ = make_docs([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "der und die das"), (3, "der und die das"), (3, "der und die das")])
    found = language.predict(odd, model).collect()
    assert len(found) == len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in found if r.doc_id not in (None, 3)}
    for i, t in enumerate(ODD_TEXTS):
        if i != 3:
            assert (by_id[i].lang_pred == "und") == (not any(map(str.isalpha, t or ""))), t
    assert language.predict(odd.limit(0), model).collect() == []
    none = language.predict(odd, language.learn(odd))  # no row has a language to learn from
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_ambiguous_texts_are_flagged(docs):
    rows = docs.where("text is not null").orderBy("doc_id").limit(300).collect()
    model = language.fit(language.vectors([r.text.encode() for r in rows]), [r.lang for r in rows], min_gap=10.0)
    assert language.identify(model, [rows[0].text.encode()])[2] == [True]
    assert language.identify(language.Codes(model.languages, model.code, model.weight, model.trust, 0.0), [rows[0].text.encode()])[2] == [False]


def test_no_model_learns_from_held_out_rows(docs, labels):
    """Turning every held-out label and language round changes no prediction."""
    from attrition.llm.common import held_out

    other = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.learn(d) for d in (docs, other))
    assert a.languages == b.languages and np.array_equal(a.weight, b.weight)
    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    a, b = (toxicity.learn(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias
    a, b = (quality.learn(docs, x) for x in (labels, turned))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def rates(found, labels, name):
    rows = found.where("held_out").join(labels.where(F.col(name).isNotNull()), "doc_id").collect()
    hit = [r for r in rows if r[name] == 1]
    miss = [r for r in rows if r[name] == 0]
    return sum(r.predicted for r in hit) / len(hit), sum(r.predicted for r in miss) / len(miss)


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.predict(docs, toxicity.learn(docs, labels))
    recall, false = rates(found, labels, "toxic")
    assert recall > 0.8 and false < 0.04


def test_quality_on_held_out_rows(docs, labels):
    recall, false = rates(quality.predict(docs, quality.learn(docs, labels)), labels, "quality")
    assert recall > 0.95 and false < 0.1


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    m = quality.Model(None, unit(rng.standard_normal((400, 8))), rng.integers(0, 2, 400).astype(float), 7, 3.0)
    z = unit(rng.standard_normal((150, 8)))
    want = []
    for row in z:
        cos = m.vectors @ row
        top = np.argsort(-cos)[:7]
        w = np.maximum(cos[top], 0) ** 3
        want.append((w * m.labels[top]).sum() / w.sum())
    assert np.allclose(quality.vote(m, z, block=64), want)
    assert np.allclose(quality.vote(m, np.zeros((2, 8))), m.labels.mean())


def test_score_edge_rows(spark, make_docs, docs, labels):
    odd, _, _ = make_docs([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x"), (1, "twice"), (1, "twice")])
    nulls = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    for module in (toxicity, quality):
        found = module.predict(odd, module.learn(docs, nulls)).collect()
        assert len(found) == len(ODD_TEXTS) + 3 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
        assert module.predict(odd.limit(0), module.learn(docs, nulls)).collect() == []
        bare = module.predict(odd, module.learn(odd.limit(0), labels.limit(0))).collect()
        assert {r.score for r in bare} == {0.0}
    kept = toxicity.keep_clean(odd, toxicity.learn(docs, labels))
    assert kept.columns == odd.columns


def test_equal_neighbours_are_taken_by_doc_id():
    """Twenty equal labelled vectors with mixed labels, among others: the first seven vote."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    other = unit(rng.standard_normal((30, 8)))
    one = unit(rng.standard_normal((1, 8)))
    place = np.sort(rng.choice(50, 20, replace=False))
    vectors, labels = np.empty((50, 8)), rng.integers(0, 2, 50).astype(float)
    vectors[np.setdiff1d(np.arange(50), place)] = other
    vectors[place] = one
    m = quality.Model(None, vectors.astype(np.float32), labels, 7, 8.0)
    assert np.allclose(quality.vote(m, np.repeat(one, 5, 0).astype(np.float32)), labels[place[:7]].mean())
    m = quality.Model(None, vectors.astype(np.float32), labels, 25, 0.0)  # all twenty and the five nearest others, each with one vote
    best = np.argsort(-(other @ one[0]))[:5]
    five = labels[np.setdiff1d(np.arange(50), place)][best]
    assert (other @ one[0])[best].min() > 0 and np.allclose(quality.vote(m, one.astype(np.float32)), (labels[place].sum() + five.sum()) / 25)


def test_quality_vectors_lie_by_doc_id(docs, labels):
    twice = docs.where("doc_id < 60")
    copies = twice.unionByName(twice.withColumn("doc_id", F.col("doc_id") + 100_000))
    known = labels.unionByName(labels.withColumns({"doc_id": F.col("doc_id") + 100_000, "quality": 1 - F.col("quality")}))
    model = quality.learn(copies, known)
    ids = sorted(r.doc_id for r in copies.join(known.where("quality IS NOT NULL").select("doc_id").distinct(), "doc_id").select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    want = {r.doc_id: r.quality for r in known.groupBy("doc_id").agg(F.min("quality").alias("quality")).collect()}
    assert model.labels.tolist() == [want[i] for i in ids]


def test_languages_are_decoded_as_by_loops(docs):
    rows = docs.where("text is not null").orderBy("doc_id").limit(200).collect()
    texts = [r.text.encode() for r in rows]
    model = language.fit(language.vectors(texts), [r.lang for r in rows])
    best, share, flag = language.decode(model, texts[:40])
    for i, x in enumerate(language.vectors(texts[:40])):
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, sign in enumerate(word):
                margin = sum(float(a) * float(b) for a, b in zip(x, model.weight[:, bit], strict=True) if a)
                loss += float(model.trust[bit]) * math.log1p(math.exp(-sign * margin))
            losses.append(loss)
        ranked = sorted(losses)
        assert best[i] == losses.index(ranked[0]) and flag[i] == (ranked[1] - ranked[0] < model.min_gap)
        assert abs(share[i] - 1 / sum(math.exp(4 * (ranked[0] - v)) for v in losses)) < 1e-4


def test_only_the_most_frequent_languages_are_learned(docs):
    model = language.learn(docs, max_languages=2)
    counts = {r.lang: r.n for r in docs.where("text is not null and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(model.languages) == 2 and "en" in model.languages and set(model.languages) <= set(counts)


def risk(zp, zu, prior):
    """The non-negative risk, written out; and the part that its step follows."""
    loss = lambda z, y: math.log1p(math.exp(-y * z))
    positive = prior * sum(loss(z, 1) for z in zp) / len(zp)
    negative = sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)
    return -negative if negative < 0 else positive + negative


@pytest.mark.parametrize("high,low,prior", [(-1.0, 1.0, 0.1), (3.0, -4.0, 0.4), (0.0, 0.0, 0.25)])
def test_slopes_are_the_differences_of_the_risk(high, low, prior):
    rng = np.random.default_rng(8)
    zp, zu = high + rng.normal(0, 0.3, 5), low + rng.normal(0, 0.3, 9)
    up, un = toxicity.nn_slopes(zp, zu, prior)
    for z, slope in ((zp, up), (zu, un)):
        for i in range(len(z)):
            z[i] += 1e-5
            above = risk(zp, zu, prior)
            z[i] -= 2e-5
            below = risk(zp, zu, prior)
            z[i] += 1e-5
            assert abs((above - below) / 2e-5 - slope[i]) < 1e-6


def test_toxicity_scores_equal_a_loop_over_words(docs, labels):
    from attrition.llm.common import mix, span_hashes
    from attrition.llm.ngrams import LETTERS

    model = toxicity.learn(docs, labels)
    texts = [(t or "").encode() for t in ODD_TEXTS] + [r.text.encode() for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]

    def column(data, salt=0):
        code = span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
        return int((mix(code + np.uint64(2)) if salt else code)[0] >> np.uint64(64 - toxicity.BITS))

    want = []
    for t in texts:
        words = t.translate(LETTERS).split()
        z = sum(float(model.weight[column(w)]) + (float(model.weight[column(w[:4], 2)]) if len(w) > 4 else 0.0) for w in words)
        want.append(1 / (1 + math.exp(-(z / math.sqrt(max(len(words), 1)) + model.bias))))
    assert np.abs(toxicity.scores(model, texts) - np.array(want)).max() < 1e-5


def test_nnpu_steps_back_where_the_negative_risk_is_below_zero():
    up, un = toxicity.nn_slopes(np.full(4, 5.0), np.full(4, -5.0), 0.4)
    assert (up > 0).all() and (un < 0).all()
    up, un = toxicity.nn_slopes(np.full(4, -1.0), np.full(4, 1.0), 0.1)
    assert (up < 0).all() and (un > 0).all()


def test_texts_stay_where_no_language_can_be_learned(make_docs):
    docs, _, _ = make_docs([(1, "a clean text"), (2, "123 ..."), (3, None), (4, "\u7684 \u6587 \u5b57"), (5, "")])
    assert sorted(r.doc_id for r in language.keep_identified(docs, language.learn(docs)).collect()) == [1, 4]


def test_language_fit_holds_its_vectors_once(spark):
    """The driver gets vectors in a fraction of their bytes, and the fit makes no copy of them."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "and", "der", "und", "les", "des", "house", "baum"], 60)) for _ in range(400)]
    got = language._packed(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    whole = 2 * ((1 << language.BITS) + 1)
    assert len(got) == 400 and max(len(r.x) for r in got) < whole / 4
    x = language.vectors([t.encode() for t in texts])
    tracemalloc.start()
    language.fit(x, ["ab"[i % 2] for i in range(400)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2, (peak, x.nbytes)
