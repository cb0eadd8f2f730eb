"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """The first n powers of _B and of its inverse. Those that a chunk needs are kept; more, for a very long text, are made for it alone."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_B, np.uint64(pow(int(_B), -1, 1 << 64))):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        made.append(np.multiply.accumulate(table))
    if n <= 2 * CHUNK:
        _powers[:] = made
    return made


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: a hash, the text, and the first and last byte within the joined texts.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z. A word's hash is a polynomial in
    its bytes modulo 2**64, from differences of running sums, then mixed.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingles(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of so many words; of fewer words, one hash of all; of none, none."""
    hashes, owner, _, _ = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(0, len(hashes) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs = runs * _STEP + hashes[k : k + n]
    runs = mix64(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    one = one * _STEP + h
            out.append(mix64(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(sizes: list[int]):
    """Consecutive slices of texts of these sizes with at most CHUNK bytes, one text at least."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK):
            size += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def set_key(hashes: np.ndarray) -> bytes:
    """A 128-bit name of a sorted set of hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
