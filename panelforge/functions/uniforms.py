"""The portable uniform numbers of ``expressions.uniform`` for whole blocks of keys and replicates, and rounding, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Fixed values of MD5 (RFC 1321): constants, rotations and the word that each step takes.
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that MD5 takes in one block.
ONE_BLOCK = 55
#: Messages of a pass, about, so that its arrays stay in the processor's cache.
MESSAGES = 1 << 14


def rounded_numbers(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as SQL's ROUND does: scaled, and halves of the scaled numbers away from zero."""
    x = x * 10.0**digits
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) == 0.5, whole + np.copysign(1.0, x), np.rint(x)) / 10.0**digits + 0.0


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first word of the digest of messages of one block, 16 words each (words x messages).

    A word that all messages share goes with the step's constant, the last three steps do not reach the first word, and the registers' memory is used again."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    shared = [None if n == 0 or (w != w[0]).any() else int(w[0]) for w in words]
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = _WORDS[i]
        if shared[word] is None:
            f += words[word]
        f += np.uint32((_SINES[i] + (shared[word] or 0)) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g)
        f >>= np.uint32(32 - _TURNS[i])
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return b + np.uint32(_START[0])


def _of_lengths(prefixes: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Keys x prefixes: numbers of every key (rows of bytes, all of one length) behind every prefix (all of one length)."""
    before, size = len(prefixes[0]), len(prefixes[0]) + keys.shape[1]
    if size > ONE_BLOCK:
        return np.array([[int.from_bytes(hashlib.md5(p + k.tobytes()).digest()[:4], "big") for p in prefixes] for k in keys]) / 2.0**32
    block = np.zeros((len(keys), len(prefixes), 64), np.uint8)
    block[:, :, :before] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(len(prefixes), before)
    block[:, :, before:size] = keys[:, None]
    block[:, :, size] = 0x80
    block.view("<u8")[:, :, 7] = 8 * size
    words = np.ascontiguousarray(block.view("<u4").reshape(-1, 16).T)
    return (_first_words(words).byteswap() / 2.0**32).reshape(len(keys), len(prefixes))


def uniforms(seed: int, replicates: range, keys: list[str]) -> np.ndarray:
    """Keys x replicates: the number of '<seed>|<replicate>|<key>' in [0, 1)."""
    out = np.empty((len(keys), len(replicates)))
    raw = [k.encode() for k in keys]
    sizes = np.array([len(k) for k in raw], dtype=int)
    prefixes = [f"{seed}|{r}|".encode() for r in replicates]
    widths = np.array([len(p) for p in prefixes], dtype=int)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        same = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size)
        for width in np.unique(widths):
            of = np.flatnonzero(widths == width)
            step = max(1, MESSAGES // len(of))
            for lo in range(0, len(at), step):
                out[np.ix_(at[lo : lo + step], of)] = _of_lengths([prefixes[j] for j in of], same[lo : lo + step])
    return out
