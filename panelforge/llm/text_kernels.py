"""Numpy kernels over Arrow string batches: bounded chunks, word spans, 64-bit word and shingle hashes.

Every kernel sees whole texts. Chunks hold whole documents and end at about ``CHUNK_BYTES``; a longer
document is a chunk of its own, whose bytes are hashed in segments of that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LUT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the rolling base, or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1) + 1, _U(_BASE_INVERSE if inverse else _BASE))
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all their bits depend on all bits of the input."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def separators(kind: str) -> np.ndarray:
    """Which bytes part words: ``space`` is [\\x20\\x09-\\x0D]; ``symbol`` is all ASCII but 0-9 and lower-case a-z."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[32, 9, 10, 11, 12, 13]] = True
    else:
        out[:128] = True
        out[48:58] = False
        out[97:123] = False
    return out


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole documents; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    else:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        lo, hi = offsets[row], offsets[end]
        yield row, data[lo:hi], offsets[row : end + 1] - lo
        row = end


class Words:
    """Words of a chunk: byte spans, document number, lower-cased bytes, and ``hashes()``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "space"):
        self.data = lower_table()[data]
        self.offsets = offsets
        self._total: np.ndarray | None = None
        inside = ~separators(kind)[self.data]
        begins, stops = inside.copy(), np.zeros(len(data) + 1, bool)
        begins[1:] &= ~inside[:-1]
        stops[1:] = inside
        stops[1:-1] &= ~inside[1:]
        # A word ends where its document does.
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut - 1]]
        begins[cut] = True
        stops[cut] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each document, one more at the end

    def hashes(self, first: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its ``first`` bytes; data beyond a chunk's size is taken in segments of whole words."""
        end = self.end if first is None else np.minimum(self.end, self.start + first)
        if len(self.data) <= CHUNK_BYTES:
            if self._total is None:
                self._total = running_hash(self.data)
            raw = (self._total[end] - self._total[self.start]) * powers(len(self.data) + 1, inverse=True)[self.start]
        else:
            raw, i = np.empty(len(end), np.uint64), 0
            while i < len(end):
                lo = self.start[i]
                j = int(np.searchsorted(end, lo + CHUNK_BYTES, "right"))
                if j > i:
                    total = running_hash(self.data[lo : end[j - 1]])
                    raw[i:j] = (total[end[i:j] - lo] - total[self.start[i:j] - lo]) * powers(CHUNK_BYTES + 1, inverse=True)[self.start[i:j] - lo]
                else:
                    j, raw[i] = i + 1, long_hash(self.data[lo : end[i]])
                i = j
        return mix(raw + (end - self.start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' values times rising powers of the rolling base, from 0 on."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LUT[data] * powers(len(data)), out=total[1:])
    return total


def long_hash(data: np.ndarray) -> np.uint64:
    """The last of ``running_hash``, piece by piece."""
    out = 0
    for lo in range(0, len(data), CHUNK_BYTES):
        piece = int(running_hash(data[lo : lo + CHUNK_BYTES])[-1])
        out = (out + piece * pow(_BASE, lo, 1 << 64)) % (1 << 64)
    return _U(out)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on."""
    n = len(data) - size + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, n, CHUNK_BYTES):
        hi = min(lo + CHUNK_BYTES, n)
        total = running_hash(data[lo : hi + size - 1])
        out[lo:hi] = mix((total[size:] - total[:-size]) * powers(CHUNK_BYTES + 1, inverse=True)[: hi - lo])
    return out


def combine(parts: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """Order-dependent 64-bit hash of aligned hash columns."""
    out = np.full(len(parts[0]), _U(seed))
    for p in parts:
        out = out * _U(0xD1342543DE82EF95) + p
    return mix(out)


def content_key(data: bytes) -> tuple[int, int]:
    """128-bit key of a text as two signed 64-bit integers; equal texts have equal keys."""
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
