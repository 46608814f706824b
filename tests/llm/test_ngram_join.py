"""The Jaccard join against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelforge.llm import ngram_join
from tests.llm import cases


def near_copies(seed: int = 5) -> list[str]:
    """Copies of a few texts with so many words changed that similarities lie on both sides of 0.8, and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7)))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(4):
        base = [word() for _ in range(rnd.randint(20, 120))]
        out.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 35))):
                copy[rnd.randrange(len(copy))] = word()
            out.append("  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    out += [" ".join(passage + [word() for _ in range(rnd.randint(3, 30))]) for _ in range(40)]
    return out


@pytest.mark.parametrize(("tile", "dense", "hub", "large"), [(2048, 4, 256, 256), (6, 0, 2, 1 << 30), (8, 4, 2, 16)])
def test_classes_equal_all_pairs(spark, sf_dir, tables, monkeypatch, tile, dense, hub, large):
    """The second case cuts groups into tiles, takes every one beyond a leaf as dense and spreads a node's pairs over buckets; the third has large groups."""
    for name, value in (("TILE", tile), ("DENSE", dense), ("HUB", hub), ("LARGE", large)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = cases.awkward() + near_copies() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = list(enumerate(texts))
    where = tables(documents=(cases.documents(texts), cases.SCHEMA))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op4_ngram_join(spark, where).collect()}
    assert got == cases.linked(rows)


def test_empty_table_and_repeated_ids(spark, tables):
    where = tables(documents=([(3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "A  b\tc"), (6, None), (6, "")], "doc_id bigint, text string"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.op4_ngram_join(spark, where).collect())
    assert got == [("3", 1, 3), ("3", 1, 3), ("5", 1, 3), ("6", 0, 6), ("6", 0, 6), ("None", 1, 3)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.joined(empty).count() == 0


def test_tree_finds_every_pair_within_the_bound():
    rnd = np.random.default_rng(3)
    points = rnd.poisson(3, (300, 64)).astype(np.uint8)
    points[100:200] = points[:100] + (rnd.random((100, 64)) < 0.1)
    sizes = points.sum(1).astype(np.int64)
    q, p, _ = ngram_join.CountTree(points, sizes).search(points, sizes)
    bound = np.minimum(points[:, None], points[None]).sum(2, dtype=np.int64)
    total = sizes[:, None] + sizes[None]
    near = (100 * sizes[:, None] >= 80 * sizes[None]) & (100 * sizes[None] >= 80 * sizes[:, None]) & (180 * bound >= 80 * total)
    assert set(zip(*np.nonzero(near), strict=True)) <= set(zip(q, p, strict=True))
