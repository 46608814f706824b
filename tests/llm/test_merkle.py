"""The Merkle manifest against hashlib and plain loops over levels."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelforge.llm import merkle, sha256

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, hash int, pos string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def folded(levels: list[list[str]], at: int, own: str) -> tuple[list[str], str]:
    siblings = []
    for nodes in levels[:-1]:
        run = nodes[at & ~1 : (at & ~1) + 2]
        run[at & 1] = own
        siblings += [x for k, x in enumerate(run) if k != at & 1]
        own, at = h(*run), at >> 1
    return siblings, own


def expected(rows) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda c: (c is not None, (c or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, tree([leaf(r) for r in own]))
    top = tree([trees[lang][1][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            one, subroot = folded(levels, at, leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r))
            two, root = folded(top, k, subroot)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*one, *two), root, root == top[-1][0]))
            assert tampered == (root != top[-1][0])
    return sorted(out, key=str)


def rows_of(sizes: dict, seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    texts = [None, "", "one", "é 中文 🙂", "a|b:1", "long " * 30_000]
    ids = iter(rnd.sample(range(-2000, 10_000), sum(sizes.values())))
    return [(next(ids), rnd.choice(["s", None, ""]), lang, rnd.choice([None, 0, 7, -1]), rnd.choice(texts[:5]), 1, "x") for lang, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize(
    ("block", "sizes"), [(11, {"en": 1}), (11, {"en": 2, None: 1}), (1, {"en": 37, "de": 5, "": 1, "é": 9, "Z": 64, None: 3}), (3, {"en": 130, "de": 8}), (2, {"en": 65})]
)
def test_manifest_equals_plain_loops(spark, tables, monkeypatch, block, sizes):
    rows = rows_of(sizes)
    rows += [(None, "s", rows[0][2], 5, "no id", 1, "x"), (None, None, rows[0][2], None, None, 1, "x"), rows[0], rows[0]] if len(rows) > 100 else []
    if len(rows) > 2:
        rows[1] = (*rows[1][:4], "long " * 30_000, 1, "x")
    monkeypatch.setattr(merkle, "BLOCK", block)
    where = tables(documents=(rows, SCHEMA))
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, where).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_empty_table(spark, tables):
    out = merkle.op11_merkle_manifest(spark, tables(documents=([], SCHEMA)))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_states_resume_where_they_were_kept():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(50)]
    columns = sha256.from_bytes(digests)
    assert sha256.to_bytes(columns) == digests
    kept = sha256.extend(sha256.start(50), columns)
    text = lambda k: digests[k].hex().encode()
    assert sha256.to_bytes(sha256.finish(kept, 1)) == [hashlib.sha256(text(k)).digest() for k in range(50)]
    both = [hashlib.sha256(text(k) + text(49 - k)).digest() for k in range(50)]
    assert sha256.to_bytes(sha256.finish(sha256.extend(kept, columns[:, ::-1]), 2)) == both
    counts = np.arange(50, dtype=np.uint32) % 3
    states = sha256.start(50)
    for k in (1, 2):
        states[:, counts >= k] = sha256.extend(states[:, counts >= k], columns[:, counts >= k])
    assert sha256.to_bytes(sha256.finish(states, counts)) == [hashlib.sha256(text(k) * n).digest() for k, n in enumerate(counts.tolist())]


def test_folding_hashes_no_left_sibling(monkeypatch):
    """Only kept states, replacements and right siblings go in."""
    seen = []
    extend = sha256.extend
    digests = sha256.from_bytes([hashlib.sha256(bytes([k])).digest() for k in range(8)])
    block = merkle.Subtree(digests, 8, 11)
    monkeypatch.setattr(sha256, "extend", lambda state, d: (seen.extend(sha256.to_bytes(d)), extend(state, d))[1])
    own = digests[:, 7:]
    for slot, state, sibling in block.steps():
        own = merkle._resumed(own, slot[7:], state[:, 7:], sibling[:, 7:])
    assert sha256.to_bytes(own) == sha256.to_bytes(block.levels[-1]) and len(seen) == 3
    assert not set(seen[1:]) & set(sha256.to_bytes(digests)[:7])
