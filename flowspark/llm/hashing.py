"""64-bit hashes of words and word shingles, a batch of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_DRAW = np.random.default_rng(7919)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20  # bytes of text that are hashed at a time; a longer text is a chunk of its own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near values part (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64 for i below n. Those of a chunk are kept."""
    if n <= len(_POWERS[0]):
        return _POWERS[0][:n], _POWERS[1][:n]
    up, down = np.full(n, _STEP), np.full(n, _STEP_BACK)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    if n <= 2 * CHUNK:
        _POWERS[:] = up, down
    return up, down


def lower(a: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[a]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of runs of texts of about CHUNK bytes, and where each text begins, with one end more. A null is an empty
    text."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        yield raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words_of(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word between ASCII white space of the texts that begin at `at` in a, and where each text's words begin."""
    inside = ~_SPACE[a]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = at[1:-1]
    border = border[(border > 0) & (border < len(a))]
    first[border], last[border - 1] = inside[border], inside[border - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(max(1, len(a)))
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def shingle_sets(a: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_set of each text of a chunk, one after another, and where each begins, with one end more."""
    words, begin = words_of(a, at)
    n = np.diff(begin)
    short = np.flatnonzero((n > 0) & (n < size))
    count = np.maximum(n - size + 1, 0)
    count[short] = 1
    place = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(place[-1], dtype=np.uint64)
    long = np.ones(len(out), dtype=bool)
    long[place[short]] = False
    m = len(words) - size + 1
    if m > 0:
        of = np.repeat(np.arange(len(n)), n)
        h = _hash_runs(words, size, m)
        out[long] = h[of[:m] == of[size - 1 :]]
    for i in short:
        out[place[i]] = _hash_runs(words[begin[i] : begin[i + 1]], n[i], 1)[0]
    for i, j in zip(place[:-1], place[1:]):
        out[i:j].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[place[:-1][count > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[place]


def _hash_runs(words: np.ndarray, k: int, n: int) -> np.ndarray:
    """A hash of each of the first n runs of k words."""
    up, _ = powers(int(k))
    h = np.full(n, np.uint64(k))
    for i in range(int(k)):
        h = h + mix(words[i : n + i] + up[i]) * up[i]
    return mix(h)


def windows(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` bytes."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(raw))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(_BYTE[raw] * up)])
    return mix((total[size:] - total[:n]) * down[:n])
