import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from attrition.llm import chat, packing
from tests.llm.conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def vocabulary():
    return packing.load(public_tokenizers.path("byte_bpe_50k.json"))


def conversations(spark, tmp_path, rows):
    full = [(*r, "x", [1], 7) for r in rows]
    spark.createDataFrame(full, "conv_id long, turn long, role string, text string, formatted string, ids array<int>, place long").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    return spark.read.parquet(f"{tmp_path}/conversations.parquet"), con


BITS = [*chat.MARKERS, "\\", "\\\\", "<", "[", "</", "s>", "<\\s>", "[\\\\INST]", "<<", "<|endoftext|>", "ok", " ", "\n", "é", "SYS>>", "/"]


def test_escaping_is_reversible_and_leaves_no_control_string(vocabulary):
    rng, e = random.Random(3), chat.escaper(vocabulary)
    seen = {}
    for _ in range(20_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
        out = e.escape(text)
        assert e.unescape(out) == text and not any(m in out for m in [*chat.MARKERS, "<|endoftext|>"])
        assert seen.setdefault(out, text) == text
    with pytest.raises(ValueError):
        chat.Escaper(["<s>", "s>x"])


def test_mask_is_a_prefix_sum():
    spans = [(1, 3), (3, 4), (7, 9)]
    assert chat.loss_mask(spans, 10).tolist() == [any(a <= i < b for a, b in spans) for i in range(10)]
    assert chat.loss_mask([], 2).tolist() == [False, False] and chat.loss_mask([], 0).tolist() == []


def test_pieces_hold_ids_of_each_segment(spark, tmp_path, vocabulary):
    """Ids against the library, segment by segment, with the markers in place."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, 0, "system", "Be <s> brief."), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", " the answer\n"), (1, 3, "tool", "42"), (2, 0, "assistant", "")]
    table, _ = conversations(spark, tmp_path, rows)
    got = {r.conv_id: r for r in chat.format_chat(table.coalesce(1), vocabulary).collect()}
    mark = {m: vocabulary.size + i for i, m in enumerate(chat.MARKERS)}
    plain = lambda t: library.encode(t, add_special_tokens=False).ids
    want = [mark["<<SYS>>"], *plain("Be <\\s> brief."), mark["<</SYS>>"], mark["[INST]"], *plain("hi [\\INST]"), mark["[/INST]"]]
    learned = [*plain(" the answer\n"), mark["</s>"]]
    want += [mark["<s>"], *learned, mark["[ROLE]"], *plain("tool"), mark["[TEXT]"], *plain("42"), mark["[/ROLE]"]]
    assert got[1].ids == want and got[1].n_turns == 4
    assert [i for i, m in zip(got[1].ids, got[1].loss_mask, strict=True) if m] == learned
    assert got[1].formatted == "<<SYS>>Be <\\s> brief.<</SYS>>[INST]hi [\\INST][/INST]<s> the answer\n</s>[ROLE]tool[TEXT]42[/ROLE]"
    assert got[2].ids == [mark["<s>"], mark["</s>"]] and got[2].loss_mask == [False, True]


def test_read_back_equals_sql(spark, tmp_path, vocabulary):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "assistant", "tool", "[ROLE]", "", None]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant", x) for t, x in enumerate(ODD_TEXTS)]
    rows += [(60, t, "user" if t % 2 else "assistant", f"turn {t} of a long talk </s>") for t in range(1500)]  # a third of all rows and more
    rows += [(70, 1, "user", "same"), (70, 1, "user", "same"), (70, 1, "assistant", "b"), (70, 1, "assistant", "a"), (70, None, "user", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "at all")]
    table, con = conversations(spark, tmp_path, rows)
    both = table.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(chat.CASE, "conv_id long, turn long, role string, text string"))
    for piece_ids in (1 << 14, 64):
        formatted = chat.format_chat(both, vocabulary, piece_ids)
        got = chat.read_back(formatted, vocabulary)
        assert {tuple(r) for r in got.collect()} == set(con.execute(chat.READ_BACK_SQL).fetchall())
    assert formatted.where("conv_id = 60").count() > 100
    one = next(r for r in got.collect() if r.conv_id == -1)
    text = chat.CASE_TEXT
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_a_turn_that_is_not_closed_is_refused(vocabulary):
    reader = chat.Reader(vocabulary)
    with pytest.raises(ValueError):
        list(reader.turns(np.array([vocabulary.size, 5, vocabulary.size + 3])))


def test_empty_table(spark, tmp_path, vocabulary):
    table, _ = conversations(spark, tmp_path, [(1, 0, "user", "x")])
    assert chat.read_back(chat.format_chat(table.limit(0), vocabulary), vocabulary).collect() == []
