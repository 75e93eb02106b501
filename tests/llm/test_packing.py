import itertools
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from attrition.llm import packing
from tests.llm.conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return packing.load(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(vocabulary, library):
    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "é", "的", "😀", "'s", "'LL", "ing", " the", "<|endoftext|>", "23", "½", "\xa0", "\x00", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(1500)]
    texts += [t or "" for t in ODD_TEXTS]
    coder = vocabulary.encoding()
    end = "<|endoftext|>"
    texts += [end, f"{end}x", f"x {end}", f"x {end} y", end * 2, f"in{end}side", f"  {end}  ", f"a\n{end}\nb", end[:-1], f"<|{end}|>", end.upper()]
    assert [packing.token_ids(coder, t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_with_flags_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"lstrip": True}, {"single_word": True}):
        odd = spec | {"added_tokens": [spec["added_tokens"][0] | change]}
        (tmp_path / "odd.json").write_text(json.dumps(odd))
        with pytest.raises(ValueError):
            packing.load(str(tmp_path / "odd.json"))
    odd = spec | {"added_tokens": [*spec["added_tokens"], spec["added_tokens"][0] | {"content": "<|end", "id": 50257}]}
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    with pytest.raises(ValueError):
        packing.load(str(tmp_path / "odd.json"))


@pytest.mark.parametrize("dimensions,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dimensions, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert set(np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).tolist()) == {1}


def check_pieces(rows, texts, library, size):
    """Every document's ids lie in gapless pieces; sequences are full but for the last."""
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens >= r.start + r.length and r.length > 0
    for doc, copies in want.items():
        assert sorted(i for ids in copies for i in range(len(ids))) == sorted(i for p in by_doc[doc] for i in range(p.start, p.start + p.length))
        if len(copies) == 1:
            pieces = sorted(by_doc[doc], key=lambda p: p.start)
            if "ids" in pieces[0]:
                assert [i for p in pieces for i in p.ids] == copies[0]
            else:
                flat = np.array(copies[0], "<u4")
                assert all(p.ids_crc32 == zlib.crc32(flat[p.start : p.start + p.length].tobytes()) for p in pieces)
    for parts in by_sequence.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1]
    totals = {s: sum(n for _, n in p) for s, p in by_sequence.items()}
    assert sorted(totals) == list(range(len(totals))) and all(n == size for s, n in totals.items() if s < len(totals) - 1)


def test_pieces_cover_every_id_once(make_docs, vocabulary, library):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) for _ in range(rng.choice([0, 1, 9, 200, 3000])))) for i in range(60)]
    texts += [(100 + i, t) for i, t in enumerate([*ODD_TEXTS, "x <|endoftext|> y<|endoftext|>"])] + [(7000, "copy"), (7000, "copy"), (None, "no id")]
    docs, _, _ = make_docs(texts)
    for size, digest in ((1024, False), (64, True)):
        check_pieces(packing.pack(docs, vocabulary, size, digest).collect(), texts, library, size)


def test_neighbours_on_the_curve_share_sequences(make_docs, vocabulary):
    """Documents of three languages of words, shuffled, come out in a few runs."""
    rng = random.Random(5)
    kinds = [["die", "und", "der", "nicht"], ["the", "and", "with", "that"], ["que", "los", "para", "una"]]
    texts = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(40))) for i in range(90)]
    docs, _, _ = make_docs(texts)
    rows = [r for r in packing.pack(docs, vocabulary).collect() if r.start == 0]
    order = [r.doc_id % 3 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) < 30


def test_empty_table(make_docs, vocabulary):
    docs, _, _ = make_docs([(1, "x")])
    assert packing.pack(docs.limit(0), vocabulary).collect() == []
