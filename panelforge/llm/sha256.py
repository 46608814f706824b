"""SHA-256 over many messages at once in numpy, with states that can be kept after any block of 64 bytes and resumed later.

Messages here are digests as hex text, so each is one block. States and digests are arrays of 8 rows of 32-bit words, one column a message.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_U = np.uint32
_MASK = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    x = round(n ** (1 / 3))
    for _ in range(60):
        x = (2 * x + n // (x * x)) // 3
    while x**3 > n:
        x -= 1
    while (x + 1) ** 3 <= n:
        x += 1
    return x


#: The first 32 bits of the fractional parts of roots of primes, as the standard has them.
START = np.array([isqrt(p << 64) & _MASK for p in _primes(8)], np.uint32)
ROUNDS = [_cube_root(p << 96) & _MASK for p in _primes(64)]
#: Four hex digits of each 16-bit number as a word of their characters.
_HEX = np.frombuffer(b"".join(b"%04x" % k for k in range(1 << 16)), ">u4").astype(np.uint32)


def _turn(x, by: int):
    return x >> by | x << (32 - by)


def schedule(words: list) -> list:
    """The 64 round inputs (with the round constants added) of a block of 16 words, arrays or plain integers."""
    w = list(words)
    plain = isinstance(w[0], int)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        if plain:
            turn = lambda x, by: (x >> by | x << (32 - by)) & _MASK
            w.append((w[t - 16] + w[t - 7] + (turn(a, 7) ^ turn(a, 18) ^ a >> 3) + (turn(b, 17) ^ turn(b, 19) ^ b >> 10)) & _MASK)
        else:
            w.append(w[t - 16] + w[t - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> 3) + (_turn(b, 17) ^ _turn(b, 19) ^ b >> 10))
    return [_U((x + k) & _MASK) if plain else x + _U(k) for x, k in zip(w, ROUNDS, strict=True)]


def compress(state: np.ndarray, inputs: list) -> np.ndarray:
    """The states after one more block."""
    a, b, c, d, e, f, g, h = state
    for x in inputs:
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(n: int) -> np.ndarray:
    """States before any block."""
    return np.repeat(START[:, None], n, axis=1)


def extend(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one more digest as hex text."""
    words = np.empty((16, digests.shape[1]), np.uint32)
    words[0::2], words[1::2] = _HEX[digests >> 16], _HEX[digests & 0xFFFF]
    return compress(state, schedule(list(words)))


_ends = {blocks: schedule([1 << 31, *[0] * 14, blocks * 512]) for blocks in (1, 2)}


def finish(state: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    """Digests of messages of so many blocks (1 or 2, or an array), from the states after them."""
    if isinstance(blocks, int):
        return compress(state, _ends[blocks])
    words = np.zeros((16, state.shape[1]), np.uint32)
    words[0] = 1 << 31
    words[15] = blocks * 512
    return compress(state, schedule(list(words)))


def from_bytes(digests: list[bytes]) -> np.ndarray:
    """Digests (or states) of 32 bytes as columns."""
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).T.astype(np.uint32)


def to_bytes(digests: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [data[k : k + 32] for k in range(0, len(data), 32)]
