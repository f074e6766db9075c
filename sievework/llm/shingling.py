"""64-bit hashes of word shingles, for whole batches of texts at once: words are hashed by running sums over the bytes, with no Python step a word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
PIECE = 2 << 20
"""Bytes worked on at a time; a longer text is cut between words."""
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20_240_117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of R and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data, whose last byte is white."""
    a = np.frombuffer(data.translate(_FOLD), np.uint8)
    n = 1 << max(10, (len(a) - 1).bit_length())
    up, down = _powers(n)
    inside = (a != 32).view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    run = _byte_codes()[a]
    run *= up[: len(a)]
    np.cumsum(run, out=run)
    before = np.where(starts > 0, run[starts - 1], np.uint64(0))
    return starts, _mix((run[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in them); texts + 1 offsets."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    group, size, first = [], 0, 0

    def done(upto: int) -> None:
        nonlocal group, size, first
        if group:
            starts, h = _words(b" ".join(group) + b" ")
            ends = np.cumsum([len(x) + 1 for x in group])
            at = np.searchsorted(starts, ends)
            counts[first + 1 : upto + 1] = np.diff(at, prepend=0)
            hashes.append(h)
        group, size, first = [], 0, upto

    for i, t in enumerate(texts):
        if size + len(t) > PIECE:
            done(i)
        if len(t) <= PIECE:
            group.append(t)
            size += len(t) + 1
            continue
        at = 0
        white = t.translate(_FOLD)
        while at < len(t):
            end = len(t) if at + PIECE >= len(t) else (white.rfind(b" ", at, at + PIECE) + 1 or white.find(b" ", at + PIECE) + 1 or len(t))
            _, h = _words(t[at:end] + b" ")
            counts[i + 1] += len(h)
            hashes.append(h)
            at = end
        first = i + 1
    done(len(texts))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.cumsum(counts)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k consecutive words, A-Z in lower case; with fewer words all of them as one; without words none."""
    h, at = word_hashes(texts)
    codes = [np.uint64(int(c) | 1) for c in np.random.default_rng(911).integers(1, 1 << 63, k, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = h[: len(h) - k + 1] * codes[0]
            for j in range(1, k):
                s += h[j : len(h) - k + 1 + j] * codes[j]
            s = _mix(s)
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= k:
                x = np.sort(s[lo : hi - k + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
            elif hi > lo:
                short = np.uint64(hi - lo)
                for j in range(lo, hi):
                    short = short + h[j] * codes[j - lo]
                out.append(_mix(np.array([short], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
