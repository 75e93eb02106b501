"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words (runs that start with the space mark), each distinct
word is encoded once per task, and all new words of a slice are merged
together: their symbols lie in one flat numpy array; every round looks up the
rank of each adjacent pair, takes the minimum per word, merges its leftmost
occurrences in all words at once and compacts the arrays, until no pair
remains. Where an early merge could change which pair is best (pieces of equal
score, or a longer piece that outranks its own part) only the leftmost
occurrence of a word is merged in a round, so the result is the same as that
of merging one pair at a time.

Made for BPE models with identity normalization, a dummy prefix, byte
fallback, and no user-defined symbols; ``load`` refuses others. Defined
results: null and empty texts have no ids and decode to the empty text;
repeated rows, nulls in doc_id and any text length are ordinary; an empty
table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrition.llm.common import map_arrow, slices

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Distinct words a task remembers before it starts anew.
CACHE_WORDS = 200_000

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass
class Model:
    """Numpy tables of a vocabulary; their size is bounded by it."""

    n_pieces: int
    symbol: np.ndarray  # code point -> symbol; from n_symbols on, one that merges with nothing
    n_symbols: int
    pair: np.ndarray  # sorted left * n_symbols + right
    merged: np.ndarray  # the piece each pair makes
    rank: np.ndarray  # of a piece; smaller merges first, equal scores share one
    alone: np.ndarray  # pieces of which only the leftmost may be merged in a round
    byte_id: np.ndarray
    surface: list[bytes]  # what each id decodes to
    extra: np.ndarray  # code points of the symbols from n_pieces on


def load(path: str) -> Model:
    """The tables of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  Aﬁ  ½\t\n "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("only models with identity normalization and a dummy prefix are supported")
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    bytes_of = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(bytes_of) != 256:
        raise ValueError("only models with byte fallback are supported")
    if any(re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(pieces) if i not in special):
        raise ValueError("only models whose pieces keep within a word are supported")
    ids = {p: i for i, p in enumerate(pieces) if i not in special}
    rank = np.full(n, NONE, np.int32)
    normal = np.array(sorted(ids.values()))
    score = np.array([sp.get_score(int(i)) for i in normal])
    rank[normal] = np.unique(-score, return_inverse=True)[1]
    chars = sorted({c for p in ids for c in p if len(p) > 1} - set(ids))
    symbols = ids | {c: n + k for k, c in enumerate(chars)}
    n_symbols = n + len(chars)
    symbol = np.arange(n_symbols, n_symbols + 0x110000, dtype=np.int64)
    for s, i in symbols.items():
        if len(s) == 1:
            symbol[ord(s)] = i
    shared = set(np.flatnonzero(np.bincount(rank[normal]) > 1).tolist())
    alone, pairs = np.zeros(n, bool), []
    for p, i in ids.items():
        alone[i] |= int(rank[i]) in shared
        for k in range(1, len(p)):
            a, b = symbols.get(p[:k]), symbols.get(p[k:])
            for part in (a, b):
                if part is not None and part < n and rank[i] < rank[part]:
                    alone[part] = True
            if a is not None and b is not None:
                pairs.append((a * n_symbols + b, i))
    pairs.sort()
    surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    key, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return Model(n, symbol, n_symbols, key, made, rank, alone, np.array([bytes_of[b] for b in range(256)]), surface, np.array([ord(c) for c in chars], np.int64))


def _pair_ranks(m: Model, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol with the next one: the rank (NONE: no merge) and the piece."""
    key = sym[:-1] * m.n_symbols + sym[1:]
    at = np.minimum(np.searchsorted(m.pair, key), len(m.pair) - 1)
    ok = (m.pair[at] == key) & (word[:-1] == word[1:]) & (sym[:-1] < m.n_symbols) & (sym[1:] < m.n_symbols)
    made = m.merged[at]
    return np.append(np.where(ok, m.rank[made], NONE), NONE).astype(np.int32), np.append(made, 0)


def encode_words(m: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    sym = m.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
    word = np.repeat(np.arange(len(words)), length)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        rank, made = _pair_ranks(m, sym, word)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        open_ = least != NONE
        if not open_.all():
            done.append((word[~open_], sym[~open_]))
            rank, made, least, sym, word = rank[open_], made[open_], least[open_], sym[open_], word[open_]
            if not len(sym):
                break
        at = np.flatnonzero(rank == least)
        lead = np.append(True, word[at[1:]] != word[at[:-1]])
        run = np.append(True, at[1:] != at[:-1] + 1)
        odd = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 1
        at = at[lead | ~(odd | m.alone[made[at]])]
        sym[at] = made[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, word = sym[stay], word[stay]
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return _byte_fallback(m, word[order], sym[order], len(words))


def _byte_fallback(m: Model, word: np.ndarray, sym: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece become the pieces of their UTF-8 bytes."""
    cp = np.where(sym >= m.n_symbols, sym - m.n_symbols, 0)
    if len(m.extra):
        cp = np.where((sym >= m.n_pieces) & (sym < m.n_symbols), m.extra[np.clip(sym - m.n_pieces, 0, len(m.extra) - 1)], cp)
    odd = sym >= m.n_pieces
    n = np.where(odd, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
    out, at = np.repeat(sym, n), np.cumsum(n) - n
    for size in (1, 2, 3, 4):
        pick = odd & (n == size)
        c, p = cp[pick], at[pick]
        for k in range(size):
            low = (c >> (6 * (size - 1 - k))) & 0x3F
            head = {1: c, 2: 0xC0 | (c >> 6), 3: 0xE0 | (c >> 12), 4: 0xF0 | (c >> 18)}[size]
            out[p + k] = m.byte_id[head if k == 0 else 0x80 | low]
    return out, np.bincount(np.repeat(word, n), minlength=n_words)


class Encoder:
    """Encodes texts and remembers words within a task."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        parts = [_WORD.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        flat = [w for p in parts for w in p]
        known = len(self.index)
        word = np.fromiter((self.index.setdefault(w, len(self.index)) for w in flat), np.int64, len(flat))
        if len(self.index) > known:
            ids, size = encode_words(self.model, list(self.index)[known:])
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
        size = self.size[word]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.repeat(self.start[word] - end + size, size) + np.arange(total)]
        bounds = np.append(0, end)[np.cumsum([0, *map(len, parts)])]
        return ids, np.diff(bounds)


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of ids; one leading space, that of the dummy prefix, goes."""
    raw = b"".join([model.surface[i] for i in ids])
    at = next((k for k, i in enumerate(ids) if model.surface[i]), None)
    if at is not None and raw[:1] == b" " and model.rank[ids[at]] != NONE:
        raw = raw[1:]
    return raw.decode("utf-8", "each_byte")


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ids, an array of int per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for whole in batches:
            for batch in slices(whole):
                ids, size = coder.encode(batch.column("text").to_pylist())
                bounds = pa.array(np.append(0, np.cumsum(size)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: Model) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return map_arrow(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coder, decimal = Encoder(m), [b"%d" % i for i in range(m.n_pieces)]
        for whole in batches:
            for batch in slices(whole):
                flat, size = coder.encode(batch.column("text").to_pylist())
                rows, at = [], 0
                for n in size.tolist():
                    ids = flat[at : at + n].tolist()
                    at += n
                    rows.append((n, hashlib.sha256(b",".join([decimal[i] for i in ids])).hexdigest(), hashlib.sha256(decode_ids(m, ids).encode()).hexdigest()))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
