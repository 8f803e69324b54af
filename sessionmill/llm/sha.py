"""SHA-256 whose state can be kept in a table and resumed, for many messages at once.

Digests as hexadecimal text are 64 bytes, one block each, so the state before a child of a node is eight words with nothing pending.
"""

from __future__ import annotations

import math

import numpy as np

U32 = np.uint32
_MASK = (1 << 32) - 1


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    guess = 1 << -(-x.bit_length() // 3)
    while (better := (2 * guess + x // guess**2) // 3) < guess:
        guess = better
    return guess


# The standard's constants: leading fraction bits of square roots of 8 primes, of cube roots of 64.
START = np.array([math.isqrt(p << 64) & _MASK for p in _primes(8)], U32)
_ROUND = [U32(_cube_root(p << 96) & _MASK) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U32(n)) | (x << U32(32 - n))


def step(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> U32(3))) + w[t - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> U32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (8, n) after the closing block of messages of so many (n) full blocks: their digests as words."""
    end = np.zeros((16, state.shape[1]), U32)
    end[0], end[15] = U32(1 << 31), (blocks * 512).astype(U32)
    return step(state, end)


def as_blocks(hexes: bytes) -> np.ndarray:
    """Digests as text, joined, to words (n, 16)."""
    return np.frombuffer(hexes, ">u4").astype(U32).reshape(-1, 16)


def as_hex(words: np.ndarray) -> np.ndarray:
    """Digests as words (8, n) to their text as words (n, 16)."""
    raw = np.ascontiguousarray(words.T).astype(">u4").view(np.uint8)
    text = np.stack([_HEX[raw >> 4], _HEX[raw & 15]], axis=-1).reshape(raw.shape[0], 64)
    return np.ascontiguousarray(text).view(">u4").astype(U32)


def text_of(blocks: np.ndarray) -> list[str]:
    """Words (n, 16) of digests as text to strings."""
    joined = blocks.astype(">u4").tobytes().decode("ascii")
    return [joined[i : i + 64] for i in range(0, len(joined), 64)]
