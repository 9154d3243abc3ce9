"""XXH64 (as its public specification gives it) of many byte spans at once, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
# The five primes of the specification: fixed values.
_P1 = _U(0x9E3779B185EBCA87)
_P2 = _U(0xC2B2AE3D27D4EB4F)
_P3 = _U(0x165667B19E3779F9)
_P4 = _U(0x85EBCA77C2B2AE63)
_P5 = _U(0x27D4EB2F165667C5)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of buf[start:end] for each span; buf holds bytes."""
    word = lambda *x: _U(sum(map(int, x)) % (1 << 64))
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    at8 = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    at4 = np.ndarray((len(buf) + 1,), "<u4", padded, 0, (1,))
    size = (ends - starts).astype(np.int64)
    p = starts.astype(np.int64).copy()
    h = np.full(len(p), word(seed, _P5), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        v = [np.full(len(long), x, np.uint64) for x in (word(seed, _P1, _P2), word(seed, _P2), word(seed), word(seed, -int(_P1)))]
        q, stripes = p[long], size[long] // 32
        left = stripes.copy()
        while True:
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            for i in range(4):
                v[i][on] = _round(v[i][on], at8[q[on] + 8 * i])
            q[on] += 32
            left[on] -= 1
        x = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
        for i in range(4):
            x = (x ^ _round(np.zeros(len(long), np.uint64), v[i])) * _P1 + _P4
        h[long] = x
        p[long] += 32 * stripes
    h += size.astype(np.uint64)
    end = p + size % 32
    for _ in range(3):
        on = np.flatnonzero(p + 8 <= end)
        if not len(on):
            break
        h[on] = _rotate(h[on] ^ _round(np.zeros(len(on), np.uint64), at8[p[on]]), 27) * _P1 + _P4
        p[on] += 8
    on = np.flatnonzero(p + 4 <= end)
    h[on] = _rotate(h[on] ^ (at4[p[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    p[on] += 4
    for _ in range(3):
        on = np.flatnonzero(p < end)
        if not len(on):
            break
        h[on] = _rotate(h[on] ^ (padded[p[on]].astype(np.uint64) * _P5), 11) * _P1
        p[on] += 1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))
