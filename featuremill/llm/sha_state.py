"""SHA-256 with states that can be stored: many messages at a time, each made of 64-byte blocks.

``hashlib`` can copy a state within a process, not write it. A hex digest is exactly one block, so the state after each
child of a Merkle node is eight 32-bit words, which a table can hold and another machine can resume.
"""

from __future__ import annotations

import math

import numpy as np


def _root_bits(x: int, power: int) -> int:
    """The first 32 bits of the fraction of the square (2) or cube (3) root of ``x``."""
    n = x << 32 * power
    guess = int(math.isqrt(n)) if power == 2 else round(n ** (1 / 3))
    while guess**power > n:
        guess -= 1
    while (guess + 1) ** power <= n:
        guess += 1
    return guess & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after the blocks (16, n), both 32-bit words."""
    w = [*block]
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        p = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        q = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = p + q, a, b, c, d + p, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_text(digests: np.ndarray) -> np.ndarray:
    """The hex texts (n, 64) of digests (n, 32), bytes."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, ::2], out[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return out


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """The digests' hex texts as blocks (16, n)."""
    return np.ascontiguousarray(hex_text(digests).view(">u4").astype(np.uint32).T)


def last_blocks(blocks: np.ndarray) -> np.ndarray:
    """The padding (16, n) of messages of so many whole blocks."""
    out = np.zeros((16, len(blocks)), np.uint32)
    out[0], out[15] = 0x80000000, blocks.astype(np.uint32) * np.uint32(512)
    return out


def words_to_bytes(state: np.ndarray) -> np.ndarray:
    """(8, n) words to (n, 32) bytes."""
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def bytes_to_words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T)
