"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text exactly one token can be the last one of its encoding. A suffix automaton of the vocabulary
reads the piece byte by byte and knows the longest part of any token that ends there, and so the tokens that end there, longest first; the one
whose pair with the last token before it would survive encoding is stored, and back-pointers give the ids.

Texts are cut into pieces by one pattern, whose classes of letters, numbers and white space are read off the tokenizer library's own
splitter, character by character, so that they follow its version of Unicode.

Null texts count as empty; an empty text has no ids and decodes to the empty string. Repeated rows get the same ids, whatever their doc_id; very long
texts and pieces take time in proportion to their length. An empty table gives no rows. Columns of the input that are named like the added ones are
replaced. The vocabulary file is read on each executor from a path that is a parameter; nothing is trained.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from panelforge.llm.common import bounded_batches

#: Pieces, and pairs of tokens, kept in a worker; each cache is emptied when full.
CACHE_PIECES = 400_000
#: Code points with letters, numbers or white space; the planes between have none assigned.
PLANES = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))


def _joined(before: str, splitter) -> set[str]:
    """The characters that the splitter leaves in one piece with the character before."""
    chars = [chr(c) for plane in PLANES for c in plane if c != 10]
    probe = "".join(f"{before}{c}\n" for c in chars)
    starts = {at for _, (at, _) in splitter.pre_tokenize_str(probe)}
    return {c for k, c in enumerate(chars) if 3 * k + 1 not in starts}


def _ranges(chars: set[str]) -> str:
    """The inside of a character class of sorted characters, neighbours as ranges."""
    if not chars:
        return ""
    points = np.array(sorted(map(ord, chars)))
    cut = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in np.split(points, cut))


#: Characters above the basic plane; a class that lists them is slow to refuse others, so they are looked at by themselves.
_HIGH = "\U00010000-\U0010ffff"


@functools.cache
def piece_pattern() -> str:
    """How the byte-level scheme cuts a text before merging: contractions, then letters, numbers or other symbols after at most one space, then white space."""
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    letters, numbers, others = (_joined(c, splitter) for c in "a1!")
    every = {chr(c) for plane in PLANES for c in plane}
    space = _ranges(every - letters - numbers - others)
    low = lambda chars: _ranges({c for c in chars if ord(c) < 0x10000})
    high = lambda chars: _ranges({c for c in chars if ord(c) >= 0x10000})
    run = lambda chars: f"(?:[{low(chars)}]+|[{_HIGH}](?<=[{high(chars)}]))+"
    other = f"(?:[^{space}{low(letters)}{low(numbers)}{_HIGH}]+|[{_HIGH}](?<![{high(letters)}{high(numbers)}]))+"
    return f"'(?:[sdmt]|ll|ve|re)| ?{run(letters)}| ?{run(numbers)}| ?{other}|[{space}]+(?![^{space}])|[{space}]+"


class SuffixAutomaton:
    """All parts of the words of a vocabulary (bytes -> id), and for each the longest word that is a suffix of it."""

    def __init__(self, words: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = {}
        for word in sorted(words):
            state = 0
            for byte in word:
                state = self._extended(state, byte)
        for word in words:
            state = 0
            for byte in word:
                state = self.next[state][byte]
            ends.setdefault(state, []).append(word)
        #: Of each state the longest word that ends in it or, where none does, in the nearest state of its suffixes; -1 without.
        self.longest = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            if state in ends:
                self.longest[state] = words[max(ends[state], key=len)]
            elif state:
                self.longest[state] = self.longest[self.link[state]]
        self.size = {i: len(w) for w, i in words.items()}
        #: Of each word the next shorter one that is a suffix of it.
        self.shorter = {i: next((words[w[k:]] for k in range(1, len(w)) if w[k:] in words), -1) for w, i in words.items()}
        self.step = {state << 8 | byte: to for state, steps in enumerate(self.next) for byte, to in steps.items()}
        del self.next

    def _new(self, steps: dict[int, int], link: int, length: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, byte: int) -> int:
        """The state that ``byte`` leads to from ``state``, holding no string longer than that way makes it."""
        to = self.next[state][byte]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(dict(self.next[to]), self.link[to], self.length[state] + 1)
        self.link[to] = copy
        while state >= 0 and self.next[state].get(byte) == to:
            self.next[state][byte] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, byte: int) -> int:
        if byte in self.next[last]:
            return self._split(last, byte)
        new, state = self._new({}, 0, self.length[last] + 1), last
        while state >= 0 and byte not in self.next[state]:
            self.next[state][byte] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, byte)
        return new


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """One vocabulary: ``encode_le(text)`` gives ids as little-endian 32-bit bytes, ``decode(ids)`` the text."""

    def __init__(self, path: str, pieces: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        plain = lambda token: bytes(symbols[c] for c in token)
        vocab = {plain(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (plain(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole, pair_ids = vocab[a + b], (vocab[a], vocab[b])
            self.merged[pair_ids] = r
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = r, pair_ids
        words = {token: i for token, i in vocab.items() if len(token) == 1 or i in self.rank}
        if any(bytes([byte]) not in words for byte in range(256)):
            raise ValueError(f"{path}: not every byte has a token")
        self.automaton = SuffixAutomaton(words)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = re.compile(pieces).findall
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        size = max(self.bytes_of) + 1
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.joined = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' text gives these two tokens: undo merges from the latest on and see that none across the border comes before those that built its sides."""
        rank, halves, merged = self.rank, self.halves, self.merged
        built = 1 << 60
        while True:
            across = merged.get((left, right))
            if across is not None and across < built:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # On the right side a merge of equal rank at the border happens later than one across it (merging goes from the left).
            if a > b:
                built, left = a, halves[left][1]
            else:
                built, right = b + 1, halves[right][0]

    def piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [-2] * (n + 1)  # -2: no prefix ends here; -1: the empty prefix
        last[0] = -1
        pairs, fa = self.pairs, self.automaton
        step, link, length, longest, shorter, size = fa.step.get, fa.link, fa.length, fa.longest, fa.shorter, fa.size
        state = known = 0
        for end, byte in enumerate(piece, 1):
            to = step(state << 8 | byte)
            while to is None:  # every byte is a token, so the first state has a step
                state = link[state]
                known = length[state]
                to = step(state << 8 | byte)
            state, known = to, known + 1
            token = longest[state]
            while token >= 0:
                if size[token] <= known:
                    before = last[end - size[token]]
                    if before >= 0:
                        key = before << 32 | token
                        fits = pairs.get(key)
                        if fits is None:
                            if len(pairs) >= CACHE_PIECES:
                                pairs.clear()
                            fits = pairs[key] = self.compatible(before, token)
                    else:
                        fits = before == -1
                    if fits:
                        last[end] = token
                        break
                token = shorter[token]
        ids = []
        while n:
            ids.append(last[n])
            n -= size[last[n]]
        return ids[::-1]

    def _missing(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.piece(piece.encode()))
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def _plain_le(self, text: str) -> bytes:
        pieces = self.find(text)
        get, missing = self.cache.get, self._missing
        return b"".join([get(p) or missing(p) for p in pieces])

    def encode_le(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain_le(text)
        return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self._plain_le(s) for s in self.cut.split(text) if s)

    def decode(self, ids_le: bytes | None) -> str:
        """Token bytes joined and read as UTF-8; malformed bytes become U+FFFD."""
        ids = np.frombuffer(ids_le or b"", "<u4")
        first = self.starts[ids]
        lengths = self.starts[ids + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(first - ends + lengths, lengths)
        return self.joined[at].tobytes().decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str, pieces: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, pieces)
    return _encoders[path]


def encode(text: Column, path: str) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers in a binary column."""
    pieces = piece_pattern()

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        code = encoder(path, pieces).encode_le
        return pa.array([code(t.as_py()) for t in texts], pa.binary())

    return ids(text)


def decode(ids_le: Column, path: str) -> Column:
    """The text of each row of ids."""
    pieces = piece_pattern()

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        read = encoder(path, pieces).decode
        return pa.array([read(i.as_py()) for i in ids], pa.string())

    return texts(ids_le)


def ids_array(ids_le: Column) -> Column:
    """Ids as array<int>, for readers that want them apart."""

    @F.arrow_udf("array<int>")
    def arrays(ids: pa.Array) -> pa.Array:
        every = [i.as_py() or b"" for i in ids]
        ends = np.cumsum([0, *(len(i) // 4 for i in every)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(every), "<i4")))

    return arrays(ids_le)


def tokenise(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids_le", decoded_col: str = "decoded") -> DataFrame:
    """docs with its ids and the decoded text in two columns of these names (columns of the same name are replaced)."""
    return docs.withColumn(ids_col, encode(F.col(text_col), path)).withColumn(decoded_col, decode(F.col(ids_col), path))


def with_digests(out: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the columns of ``tokenise``."""
    return out.select(
        "*",
        F.floor(F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    from public_tokenizers import path

    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_digests(tokenise(docs, path("byte_bpe_50k.json"))).drop("text", "ids_le", "decoded")
