"""Chat formatting at token level.

Every turn is encoded by itself: its text is escaped and tokenized as ordinary
text, and reserved ids above the vocabulary, which no text can produce, are
spliced in around it. Loss masks are prefix sums over +1 where an assistant's
text begins and -1 behind the id that closes it.

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>                 (loss: text and </s>)
    any other  [ROLE]role[TEXT]text[/ROLE]

A control string in a text or role gets a backslash behind its first character,
one more where it has some already, so it can't be taken for a marker and the
text comes back exactly. Added tokens of the vocabulary count as control strings.

Turns are range-partitioned by (conv_id, turn, role) and streamed, so a
conversation of any length is formatted by many tasks and never held whole: the
output is pieces of whole turns, ``place`` their order. A digest of a whole
conversation, as ``read_back`` gives, is a sequential hash and so the work of one
task, which streams the pieces in order and holds one at a time.

Defined results: null texts and roles are empty; a null conv_id is a
conversation of its own; null turns come first; rows that repeat a turn are turns
of their own, by role and text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, slices
from attrition.llm.packing import Vocabulary

#: Markers of the template: before and behind a role's text.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Markers of any other role: before its name, before and behind its text.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: Reserved ids are the size of the vocabulary plus a marker's place here.
MARKERS = [*(m for pair in ROLES.values() for m in pair), *OTHER]
#: Role whose texts are learned.
LEARNED = "assistant"


class Escaper:
    """Reversible escaping of control strings."""

    def __init__(self, controls: list[str]):
        controls = sorted(set(controls))
        for x in controls:
            if "\\" in x or len(x) < 2 or any(x[i:].startswith(y) or y.startswith(x[i:]) for y in controls for i in range(1, len(x))):
                raise ValueError(f"control string {x!r} overlaps another one, or can't be escaped")
        rest = {}
        for x in controls:
            rest.setdefault(x[0], []).append(re.escape(x[1:]))
        body = "|".join(rf"{re.escape(first)}(?=\\*(?:{'|'.join(tails)}))" for first, tails in rest.items())
        self.plain = re.compile(f"({body})")
        self.escaped = re.compile(rf"({body})\\")
        self.firsts = "".join(rest)

    def escape(self, text: str) -> str:
        return self.plain.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text)


def escaper(vocabulary: Vocabulary) -> Escaper:
    return Escaper([*MARKERS, *vocabulary.added])


def loss_mask(spans: list[tuple[int, int]], length: int) -> np.ndarray:
    """True inside the spans: a prefix sum of their ends."""
    step = np.zeros(length + 1, np.int32)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


_PIECE = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("formatted", pa.string())])
_PIECE_DDL = "conv_id long, place long, n_turns long, ids array<int>, loss_mask array<boolean>, formatted string"


def format_chat(conversations: DataFrame, vocabulary: Vocabulary, piece_ids: int = 1 << 14) -> DataFrame:
    """Pieces (conv_id, place, n_turns, ids, loss_mask, formatted) of whole turns; a
    conversation of up to ``piece_ids`` ids within one partition is one piece."""
    shared = conversations.sparkSession.sparkContext.broadcast(vocabulary)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, escape, base = shared.value.encoding(), escaper(shared.value).escape, shared.value.size
        reserved = {m: base + i for i, m in enumerate(MARKERS)}
        place = TaskContext.get().partitionId() << 33
        conv, ids, spans, shown, turns, ready, size = None, [], [], [], 0, [], 0

        def piece():
            nonlocal ids, spans, shown, turns, place, size
            if turns:
                ready.append((conv, place, turns, np.array(ids, np.int32), loss_mask(spans, len(ids)), "".join(shown)))
                size += len(ids)
            place += 1
            ids, spans, shown, turns = [], [], [], 0

        def batch_out():
            nonlocal ready, size
            conv_ids, places, n, flat, mask, text = zip(*ready, strict=True)
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (flat, mask)]
            ready, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(conv_ids, pa.int64()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), *lists, pa.array(text, pa.string())], schema=_PIECE)

        for whole in batches:
            for batch in slices(whole):
                for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                    if c != conv or len(ids) >= piece_ids:
                        piece()
                    conv, turns = c, turns + 1
                    if role in ROLES:
                        start, end = ROLES[role]
                        ids.append(reserved[start])
                    else:
                        name, end = escape(role), OTHER[2]
                        ids += [reserved[OTHER[0]], *coder.encode_ordinary(name), reserved[OTHER[1]]]
                        start = f"{OTHER[0]}{name}{OTHER[1]}"
                    text = escape(text)
                    first = len(ids)
                    ids += coder.encode_ordinary(text)
                    ids.append(reserved[end])
                    if role == LEARNED:
                        spans.append((first, len(ids)))
                    shown += [start, text, end]
                    if size >= 1 << 18:
                        yield batch_out()
        piece()
        if ready:
            yield batch_out()

    return map_arrow(dealt, run, _PIECE_DDL)


class Reader:
    """Takes formatted ids apart."""

    def __init__(self, vocabulary: Vocabulary):
        self.base, self.unescape = vocabulary.size, escaper(vocabulary).unescape
        self.table = [b""] * self.base
        for token, i in vocabulary.ranks.items():
            self.table[i] = token
        self.roles = {MARKERS.index(a): (role, MARKERS.index(b)) for role, (a, b) in ROLES.items()}
        self.other = [MARKERS.index(m) for m in OTHER]

    def text(self, ids: np.ndarray) -> str:
        return self.unescape(b"".join([self.table[i] for i in ids.tolist()]).decode())

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn."""
        at = np.flatnonzero(ids >= self.base)
        marks, k = (ids[at] - self.base).tolist(), 0
        while k < len(marks):
            if marks[k] in self.roles:
                role, end = self.roles[marks[k]]
            elif marks[k] == self.other[0] and marks[k + 1] == self.other[1]:
                role, end = self.text(ids[at[k] + 1 : at[k + 1]]), self.other[2]
                k += 1
            else:
                raise ValueError("a turn can't begin here")
            if marks[k + 1] != end:
                raise ValueError("a turn isn't closed by its own marker")
            yield role, self.text(ids[at[k] + 1 : at[k + 1]])
            k += 2

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """The text of each run under the mask."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            run = ids[a:b]
            yield self.text(run[run < self.base])


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each
    conversation, from the ids and masks of its pieces."""
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary)
    rows = formatted.select("conv_id", "place", "ids", "loss_mask", F.length("formatted").alias("chars"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, state, done = Reader(shared.value), None, []

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            masks = batch.column("loss_mask")
            ids, mask = batch.column("ids").flatten().to_numpy(), masks.flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(masks.value_lengths().to_numpy())).tolist()
            for k, (c, chars) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("chars").to_pylist(), strict=True)):
                if state is None or c != state[0]:
                    close()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                a, b = ends[k], ends[k + 1]
                for role, text in reader.turns(ids[a:b]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for text in reader.learned(ids[a:b], mask[a:b]):
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += chars
            if len(done) > 1 << 13:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)

    return map_arrow(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What the query adds to the table: texts that are themselves control strings.
CASE_TEXT = "</s>[INST] ok [/INST]"
CASE = [(-1, 0, "user", CASE_TEXT), (-1, 1, "assistant", CASE_TEXT)]

READ_BACK_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(/?s>|</?SYS>>|\|endoftext\|>)|\[\\*(/?INST\]|/?ROLE\]|TEXT\])')) AS in_text,
    len(regexp_extract_all(role, '<\\*(/?s>|</?SYS>>|\|endoftext\|>)|\[\\*(/?INST\]|/?ROLE\]|TEXT\])')) AS in_role
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + in_text + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + in_role END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
