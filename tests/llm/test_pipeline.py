"""The pipeline against plain Python: each stage's decision on its own input."""

import public_tokenizers

import corpus_pipeline
from attrition.llm import jaccard, language, packing, toxicity
from attrition.llm.common import table
from tests.llm.test_packing import check_pieces

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def lines_without_shared(rows):
    holders = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key := line.strip(WHITE)) >= 40:
                holders.setdefault(key.encode().lower(), set()).add(r.doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = {}
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if gone.get(x.strip(WHITE).encode().lower(), r.doc_id) == r.doc_id]
        out[r.doc_id] = "\n".join(kept)
    return out


def firsts(texts):
    sets = {d: set(s.tolist()) for (d, _), s in zip(texts.items(), jaccard.shingle_sets([(t or "").encode() for t in texts.values()]), strict=True)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        model = toxicity.learn(docs, table(spark, SF, "labels", "doc_id", "toxic")) if k == 0 else language.learn(docs) if k == 1 else None
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = seen[-1], spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
        ids = {r.doc_id for r in seen[-1]}
        if k == 0:
            scored = toxicity.scores(model, [(r.text or "").encode() for r in before])
            assert ids == {r.doc_id for r, p in zip(before, scored, strict=True) if p < 0.3}
        if k == 1:
            lang, _, unsure = language.identify(model, [(r.text or "").encode() for r in before])
            assert ids == {r.doc_id for r, x, u in zip(before, lang, unsure, strict=True) if x != "und" and not u}
        if k == 2:
            assert {r.doc_id: r.text for r in seen[-1]} == lines_without_shared(before)
            assert all(r.n_chars == len(r.text) for r in seen[-1])
        if k == 3:
            assert ids == firsts({r.doc_id: r.text for r in before})
            assert {r.doc_id: r.text for r in seen[-1]}.items() <= {r.doc_id: r.text for r in before}.items()
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(seen[-1], [(r.doc_id, r.text) for r in seen[-2]], library, 1024)
    assert packing.END_ID == 0


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
