"""Word and shingle hashes of many texts at once, in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

# Bytes looked at in one go; about forty bytes of memory for each.
CHUNK = 1 << 18
U64 = np.uint64
# White space, and odd multipliers for mixing.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = U64(0x9E3779B97F4A7C15)
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
_PLACES = (
    U64(0xD6E8FEB86659FD93),
    U64(0xA0761D6478BD642F),
    U64(0xE7037ED1A0B428DB),
    U64(0xC2B2AE3D27D4EB4F),
    U64(0x165667B19E3779F9),
)
_SHORT = U64(0x8EBC6AF09C88C6E3)

_is_space = np.zeros(256, bool)
_is_space[list(SPACES)] = True
_letter = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers = np.ones(0, U64)
_inverse = np.ones(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> U64(30))) * _MIX[0]
    x = (x ^ (x >> U64(27))) * _MIX[1]
    return x ^ (x >> U64(31))


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 1)
        unit = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", U64(unit))):
            table = np.full(size, base, U64)
            table[0] = 1
            globals()[name] = np.cumprod(table, dtype=U64)


def _hash_chunk(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_is_space[data]
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_letter[data] * _powers[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _inverse[starts]
    return starts, mix(hashes + (ends - starts).astype(U64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` starts, and its hash.

    A word is a run of bytes other than white space.  A word longer than a chunk
    is hashed on its own.
    """
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            cut = max(raw.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                # No white space: the chunk begins a very long word.
                tails = [p for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := raw.find(s, end)) >= 0]
                cut = min(tails, default=len(raw))
                value = int.from_bytes(hashlib.blake2b(raw[at:cut], digest_size=8).digest(), "big")
                starts.append(np.array([at]))
                hashes.append(np.array([value], U64))
                at = cut
                continue
            end = cut + 1
        s, h = _hash_chunk(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's ``k``-word shingles (``k`` at
    most 5); a text of fewer words is one shingle, one without words none."""
    raw = b"\n".join(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, words = word_hashes(raw)
    firsts = np.searchsorted(starts, bounds)
    full = np.zeros(max(len(words) - k + 1, 0), U64)
    for i in range(k):
        full += words[i : i + len(full)] * _PLACES[i]
    full = mix(full)
    sets = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= k:
            sets.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            value = np.full(1, b - a, U64) * _SHORT
            for i in range(b - a):
                value += words[a + i : a + i + 1] * _PLACES[i]
            sets.append(mix(value))
        else:
            sets.append(np.zeros(0, U64))
    return sets
