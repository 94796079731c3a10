"""SHA-256 with states that can be kept and resumed, over many inputs at once (rows of NumPy arrays).

``hashlib`` can copy a state inside a process but cannot write it down. Here a state is eight 32-bit words per row, so the
state before any 64-byte block may be stored in a table and taken up elsewhere. A digest written as hexadecimal text is one
block exactly, so a tree's parent is: one block per child, then the padding.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= n else (low, mid - 1)
    return low


# The standard derives both tables from primes: fractional bits of square roots and of cube roots.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _schedule(words: list) -> list:
    w = list(words)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(
            w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10)))
        )
    return w


def _rounds(state: np.ndarray, w: list) -> np.ndarray:
    a, b, c, d, e, f, g, h = (state[:, i].copy() for i in range(8))
    for k, word in zip(ROUND, w, strict=True):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (word + k)
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States (rows of 8 words) after one more child, given as its 32 raw digest bytes and read as hexadecimal text."""
    if not len(state):
        return state
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    block = text.view(">u4").astype(np.uint32)
    with np.errstate(over="ignore"):
        return _rounds(state, _schedule([block[:, i].copy() for i in range(16)]))


def finish(state: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """Digests (rows of 32 bytes) of inputs that end after ``n_blocks`` blocks."""
    out = np.empty((len(state), 32), np.uint8)
    for n in np.unique(n_blocks):
        rows = n_blocks == n
        padding = [np.array([x], np.uint32) for x in (0x80000000, *[0] * 13, int(n) * 512 >> 32, int(n) * 512 & 0xFFFFFFFF)]
        with np.errstate(over="ignore"):
            out[rows] = _rounds(state[rows], _schedule(padding)).astype(">u4").view(np.uint8).reshape(-1, 32)
    return out


def fresh(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))
