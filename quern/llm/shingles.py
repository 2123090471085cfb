"""Word hashes and word shingles of many texts at once, on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte, and the odd base of the word hash.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

#: Bytes of text that are handled at once; bounds the memory of one step.
CHUNK_BYTES = 2 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for later calls."""
    key = f"{base}"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK_BYTES + 1), np.uint64)
        done, step = 1, base
        while done < len(out):  # doubling
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done, step = done + more, step * step % (1 << 64)
        have = _POWERS[key] = out
        if n > CHUNK_BYTES + 1:
            del _POWERS[key]
    return have


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, A-Z lower-cased, of every text in order, and each text's
    number of words. Words are runs of bytes other than ASCII white space."""
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, stops = edges[::2], edges[1::2]  # the buffer ends with white space
    summed = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw))[: len(raw)], out=summed[1:])
    words = (summed[stops] - summed[starts]) * _powers(_INVERSE, len(raw))[starts]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return mix(words ^ (stops - starts).astype(np.uint64)), counts


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of runs of ``size`` words of each text, repeats included, and how many each text
    has. A text of fewer words has one: its whole sequence; a text without words has none."""
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    length = np.repeat(np.minimum(counts, size), number)
    padded = np.append(words, np.zeros(size, np.uint64))
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        part = padded[at + k]
        if k:
            part = np.where(k < length, part, np.uint64(k))
        out = out * np.uint64(0xD6E8FEB86659FD93) + part
    return mix(out ^ length.astype(np.uint64)), number
