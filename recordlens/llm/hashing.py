"""Vectorised 64-bit fingerprints of words, shingles and character n-grams (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes that end a word: space and the controls \x09 to \x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240917)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLANKS = np.isin(np.arange(256), list(SEPARATORS))
# Every ASCII byte but letters and digits.
NO_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of about ``limit`` characters; a null text counts as empty."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def word_hashes(texts: list[str], separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and where each text's words begin (one more at the end).

    A-Z count as a-z; a word is a run of bytes that are no separators.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded), dtype=np.uint8)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    apart = separators[data]
    inside = np.flatnonzero(~apart)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.concatenate([[True], np.diff(inside) > 1])
    at = np.flatnonzero(first)
    sizes = np.diff(np.concatenate([at, [len(inside)]]))
    place = np.arange(len(inside)) - np.repeat(at, sizes)
    terms = BYTE_CODES[_LOWER[data[inside]]] * powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(terms, at) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(inside[at], begins)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words; fewer words than that make one of them all."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * BASE + words[k:len(words) - width + 1 + k])
    return out


def all_shingles(words: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, position of the first word) of every run of ``size`` words that stays in one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * BASE + words[k:n + k])
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    inside = np.flatnonzero(owner[:n] == owner[size - 1:])
    return out[inside], inside


def char_ngrams(strings: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(string index, bucket) of every character n-gram, low to high bytes long, of the strings.

    Each string is put between ``<`` and ``>``. buckets is a power of two.
    """
    parts = [("<" + s + ">").encode("utf-8", "surrogatepass") for s in strings]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    codes, shift = BYTE_CODES[data], np.uint64(64 - int(buckets).bit_length() + 1)
    rows, cols, value = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, high + 1):
        if len(data) < n:
            break
        value = value[:len(data) - n + 1] * BASE + codes[n - 1:]
        if n >= low:
            whole = owner[:len(value)] == owner[n - 1:]
            rows.append(owner[:len(value)][whole])
            cols.append((mix(value[whole] + np.uint64(n)) >> shift).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)
