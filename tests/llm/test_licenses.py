import random

from pyspark.sql import functions as F

from attrition.llm import licenses
from oracle.compare import compare
from tests.llm.conftest import ODD_TEXTS


def texts():
    rng = random.Random(6)
    fill = ["the", "of", "work", "mit", "license", "software", "é", "42", "Zeit", "public"]
    out = []
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        for lost in (0, 1, len(w) // 5, len(w) // 4 + 1):
            kept = [x for i, x in enumerate(w) if i not in set(rng.sample(range(len(w)), lost))]
            pad = [rng.choice(fill) for _ in range(rng.choice([0, 5, 47, 95, 300]))]
            out.append(" ".join(pad) + "\n" + ", ".join(kept).title() + ".\n" + " ".join(pad[:50]))
    out += ["MIT License; mit-license (MIT\nLicense)", "cc  by cc by-sa CC BY", "GNU General Public License " * 3, "apache licenses", "mit licenseé", "workK mitK licenseİ"]
    return out


def test_equals_brute_force_in_sql(make_docs):
    rows = list(enumerate(texts() + ODD_TEXTS))
    docs, _, con = make_docs(rows)
    r = compare(licenses.scan(docs), con, licenses.SCAN_SQL)
    assert r["values_match"] and r["spark_rows"] == len(rows), r


def test_other_thresholds_find_what_every_block_holds(make_docs):
    docs, _, _ = make_docs(list(enumerate(texts())))
    for threshold in (0.5, 0.65, 1.0):
        got = {(r.doc_id, r.block, r.label) for r in licenses.template_matches(docs, threshold).collect()}
        want = set()
        for r in docs.select("doc_id", licenses.words(F.col("text")).alias("w")).collect():
            for b in range(-(-len(r.w) // licenses.STRIDE)):
                block = set(r.w[b * licenses.STRIDE : b * licenses.STRIDE + licenses.BLOCK])
                for name, t in licenses.TEMPLATES.items():
                    t = set(t.split())
                    if len(t & block) >= threshold * len(t) - 1e-9 and set(licenses.DECIDING.get(name, "").split()) <= block:
                        want.add((r.doc_id, b, name))
        assert got == want and want


def test_a_notice_without_its_deciding_words_gets_no_label(make_docs):
    texts = ["Licensed under CC BY 4.0", "Released under the License", "licensed under the license version 2.0", "released under the mit license", "licensed under cc by nc 4 0"]
    docs, _, con = make_docs(list(enumerate(texts)))
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert got == {0: "cc-by", 1: "", 2: "", 3: "mit,mit-notice", 4: "cc-by,cc-by-nc-notice"}
    assert compare(licenses.scan(docs), con, licenses.SCAN_SQL)["values_match"]


def test_a_template_longer_than_a_block(make_docs):
    long = " ".join(f"term{i}" for i in range(300))
    rows = [(i, " ".join(["pad"] * lead) + " " + long + " tail") for i, lead in enumerate((0, 1, 95, 299, 750))] + [(9, long[: len(long) // 2])]
    docs, _, _ = make_docs(rows)
    got = licenses.template_matches(docs, 1.0, {"long": long}).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4} and all(r.containment == 1 for r in got)


def test_null_ids_repeated_rows_and_empty_table(make_docs):
    docs, _, _ = make_docs([(1, "MIT License"), (1, "MIT License"), (None, "all rights reserved"), (1, "nothing")])
    got = sorted((r.doc_id or 0, r.n_base, r.labels, r.score) for r in licenses.scan(docs).collect())
    assert got == [(0, 0, "rights-reserved", 1.0), (1, 0, "", 0.0), (1, 1, "mit", 1.0), (1, 1, "mit", 1.0)]
    assert licenses.scan(docs.limit(0)).collect() == []
