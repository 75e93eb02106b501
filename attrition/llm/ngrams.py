"""Hashed features of whole texts, computed with numpy over flat buffers."""

from __future__ import annotations

import numpy as np

from attrition.llm.common import mix, span_hashes

#: Byte tables: ASCII letters lower-cased; then also all other ASCII but digits as space.
LOWER = bytes(range(256)).lower()
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def flat(texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, ``pad`` zero bytes after each, and the text each byte is of."""
    size = np.array([len(t) + pad for t in texts])
    return np.frombuffer(b"".join([t + b"\0" * pad for t in texts]), np.uint8), np.repeat(np.arange(len(texts)), size)


def byte_ngrams(texts: list[bytes], sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of byte n-grams (n at most 4) per text, hashed to 2**bits columns."""
    data, owner = flat(texts, 4)
    out, code = np.zeros(len(texts) << bits, np.int64), np.zeros(len(data), np.uint32)
    real = data != 0
    for n in range(1, max(sizes) + 1):
        code = (code << np.uint32(8)) | np.append(data[n - 1 :], np.zeros(n - 1, np.uint8)).astype(np.uint32)
        if n in sizes:
            column = ((code + np.uint32(n * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
            out += np.bincount((owner[real] << bits) + column[real], minlength=len(out))
    return out.reshape(len(texts), -1).astype(np.float32)


def word_features(texts: list[bytes], bits: int, head: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (letters and digits, A-Z lower-cased) and the first ``head`` bytes of
    longer ones, hashed: the text and the column of each feature, and words per text."""
    parts = [t.translate(LETTERS).split() for t in texts]
    n_words = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b" ".join([w for p in parts for w in p]) + b" ", np.uint8)
    if not n_words.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    end = np.flatnonzero(data == 32)
    start = np.append(0, end[:-1] + 1)
    owner = np.repeat(np.arange(len(texts)), n_words)
    long = end - start > head
    heads = mix(span_hashes(data, start[long], start[long] + head) + np.uint64(2))
    columns = np.concatenate([span_hashes(data, start, end), heads]) >> np.uint64(64 - bits)
    return np.concatenate([owner, owner[long]]), columns.astype(np.int64), n_words
