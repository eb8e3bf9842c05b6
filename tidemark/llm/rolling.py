"""Hashes of words, shingles and byte windows, made with numpy over the bytes of many texts at once.

A position hash sums ``T[byte] * BASE**position`` modulo 2**64; the difference of two sums, divided by the
power at its start, is the hash of the bytes between, wherever they stand. Every hash is mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in chunks of about so many bytes, which bounds a worker's memory; a longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_T = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Multipliers of the places within a shingle.
_K = np.random.default_rng(1789).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and lengthened as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + CHUNK // 4), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts) of runs of texts of about CHUNK bytes; nulls count as empty.

    ``starts`` has one entry more than there are texts and begins with 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the position hash, with a leading 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_T[data] * _power(BASE, len(data)), out=out[1:])
    return out


def between(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the bytes from each start to each end."""
    inverse = _power(pow(BASE, -1, 1 << 64), len(s))
    return mix((s[end] - s[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word; words are what stands between ASCII white space."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a word ends where its text ends
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(starts, begin, "right") - 1, between(sums(data), begin, end)


def shingles(data: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each text's distinct shingles of ``size`` words, sorted by both.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    text, word = word_hashes(data, starts)
    n = len(starts) - 1
    per_text = np.bincount(text, minlength=n)
    m = max(0, len(word) - size + 1)
    whole = text[:m] == text[size - 1 :] if m else np.zeros(0, bool)
    h = np.zeros(m, np.uint64)
    for j in range(size):
        h += word[j : j + m] * _K[j]
    owner, made = [text[:m][whole]], [mix(h[whole])]
    first = np.concatenate([[0], np.cumsum(per_text)])
    for length in range(1, size):
        short = np.flatnonzero(per_text == length)
        if len(short):
            h = np.full(len(short), length, np.uint64) * _K[15]
            for j in range(length):
                h += word[first[short] + j] * _K[j]
            owner.append(short)
            made.append(mix(h))
    owner, made = np.concatenate(owner), np.concatenate(made)
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (made[1:] != made[:-1])
    return owner[fresh], made[fresh]
