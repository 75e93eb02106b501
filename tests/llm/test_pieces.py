import random

import public_tokenizers
import pytest
import sentencepiece

from attrition.llm import pieces
from tests.llm.conftest import ODD_TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def strange_texts(library, n=1500):
    rng = random.Random(3)
    some = [library.id_to_piece(rng.randrange(259, 32000)) for _ in range(800)]
    bits = ["a", " ", "   ", "\n", "é", "▁", "\x00", "<s>", "<0x0A>", "😀", "bcbc", "aaaaaaa", "ﬁ", "的"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 12))).replace("▁", rng.choice(["", " "])) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 20))) for _ in range(n)]
    return texts


def test_ids_and_text_are_those_of_the_library(library, model):
    texts = strange_texts(library) + [t for t in ODD_TEXTS if t is not None]
    coder = pieces.Encoder(model)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        ids, size = coder.encode(part)
        start = 0
        for t, n in zip(part, size.tolist(), strict=True):
            mine = ids[start : start + n].tolist()
            start += n
            assert mine == library.encode(t)
            assert pieces.decode_ids(model, mine) == library.decode(mine)


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(8)
    for _ in range(2000):
        ids = [rng.randrange(0, 700) for _ in range(rng.randint(0, 10))]
        assert pieces.decode_ids(model, ids) == library.decode(ids)


def test_the_cache_may_be_cleared(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    coder = pieces.Encoder(model)
    for t in ("one two three four", "five six seven eight", "one nine"):
        assert coder.encode([t])[0].tolist() == library.encode(t)


def test_operators_round_trip_and_digest(spark, make_docs, library, model):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "same words"), (None, "same words"), (0, "again")]
    docs, _, _ = make_docs(rows)
    tokens = pieces.encode(docs, model)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in pieces.decode(tokens, model).collect())
    assert back == sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in rows)
    digest = {(r.doc_id, r.n_tokens) for r in pieces.digest(docs, model).collect()}
    assert digest == {(i, len(library.encode(t or ""))) for i, t in rows}
    assert pieces.digest(docs.limit(0), model).collect() == []
