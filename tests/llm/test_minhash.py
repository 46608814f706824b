"""Near duplicates against all pairs; the sequential test against its posterior, the minima against a plain version."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import components, minhash, ngram_join
from tests.llm import cases


def edited(rnd, words, share):
    return [f"e{rnd.random()}" if rnd.random() < share else w for w in words]


def near_texts(seed: int = 11) -> list[str]:
    """Families of near copies, chains, unlike texts around one passage, pairs at the very threshold."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([12, 60, 300]))]
        texts += [" ".join(edited(rnd, base, rnd.choice([0, 0.01, 0.03, 0.06, 0.2]))) for _ in range(12)]
    chain = [word() for _ in range(200)]
    for k in range(10):
        texts.append(" ".join(chain[k * 12 : k * 12 + 100]))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rnd.choice([5, 20, 40]))]) for _ in range(40)]
    # 36 shingles shared of 45 (80 in 100), and of 46.
    same = [word() for _ in range(39)]
    texts += [" ".join(same + [word() for _ in range(k)]) for k in (4, 5, 9, 10)] + [" ".join(same)]
    return texts + [texts[0].upper(), texts[3] + "  ", texts[5]]


@pytest.mark.parametrize("settings", [{}, {"CARRIED": 20, "HUB": 3, "STARS": 0}, {"CARRIED": 20, "HUB": 3, "SEARCHED": 0}])
def test_classes_equal_all_pairs(spark, tables, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(minhash, name, value)
    if settings:
        monkeypatch.setattr(ngram_join, "TILE", 7)
        monkeypatch.setattr(ngram_join, "CARRIED_NODES", 0)
    texts = cases.awkward() + near_texts() + ["a b c", "A b  c", "a b c d", "a b c d e"]
    rows = cases.documents(texts)
    random.Random(1).shuffle(rows)
    where = tables(documents=(rows, cases.SCHEMA))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op13_minhash(spark, where).collect()}
    expected = {i: (n, c, c == i) for i, (n, c) in cases.linked(list(enumerate(texts)), size=4).items()}
    assert got == expected


def test_null_and_repeated_ids(spark, tables):
    text = " ".join(map(str, range(50)))
    rows = [(7, text, None), (7, text + " x", "a"), (None, text, "b"), (3, "", None), (3, None, None), (None, " ", None), (None, "p q r s", None), (None, "p q r s", None)]
    out = minhash.op13_minhash(spark, tables(documents=(rows, "doc_id bigint, text string, n string"))).collect()
    assert sorted(map(tuple, out), key=str) == sorted(
        [(7, 47, 7, True), (7, 48, 7, True), (None, 47, 7, False), (3, 0, 3, True), (3, 0, 3, True), (None, 0, None, True), (None, 1, None, True), (None, 1, None, True)], key=str
    )


def test_empty_table(spark, tables):
    assert minhash.op13_minhash(spark, tables(documents=([], cases.SCHEMA))).count() == 0


def test_minima_equal_a_plain_version():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 300)]
    got = minhash.minima(sets)
    for s, row in zip(sets, got, strict=True):
        for k in (0, 7, 335):
            assert row[k] == min((int(x) >> 32) * int(minhash._FACTORS[k]) + int(minhash._TERMS[k]) & 0xFFFFFFFF for x in s)


def test_share_of_equal_minima_is_the_similarity():
    rnd = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        pairs = []
        for _ in range(40):
            n = 2000
            both = int(n * share)
            x = rnd.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            pairs += [np.unique(x[:n]), np.unique(x[n - both :])]
        jaccard = both / (2 * n - both)
        m = minhash.minima(pairs)
        assert abs((m[::2] == m[1::2]).mean() - jaccard) < 0.02
        assert abs((minhash.signature(m)[::2] == minhash.signature(m)[1::2]).mean() - jaccard - (1 - jaccard) / 256) < 0.02


@pytest.mark.parametrize("n", [48, 96, 336])
def test_least_equal_is_where_the_posterior_reaches_the_miss_probability(n):
    """The posterior integrated numerically, under a flat prior."""
    x = np.linspace(0, 1, 400_001)[1:-1]

    def posterior(m):
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        density = np.exp(log - log.max())
        return density[x >= 0.8].sum() / density.sum()

    for miss in (1e-2, 1e-4):
        m = minhash.least_equal(0.8, miss)[n]
        assert posterior(m) >= miss * 0.99 and posterior(m - 1) < miss * 1.01
    # A pair at the threshold is dropped with at most that probability.
    m = minhash.least_equal()[n]
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) <= 10 * minhash.MISS


def test_survivors_drop_pair_by_pair_what_a_plain_loop_drops():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 256, (60, minhash.BANDS * minhash.ROWS)).astype(np.uint8)
    b = np.where(rnd.random(a.shape) < np.linspace(0, 1, 60)[:, None], a, a ^ 1)
    every = np.arange(60)
    expected = [k for k in every if all((a[k, :n] == b[k, :n]).sum() >= minhash._LEAST[n] for n in range(minhash.BATCH, a.shape[1] + 1, minhash.BATCH))]
    assert minhash.survivors(a, b, every, every).tolist() == expected and 10 < len(expected) < 50


def test_shingles_of_any_size():
    batch = pa.array(["a b c d e", "a b", "", None])
    assert [[len(s) for s in ngram_join.shingle_sets(batch, k)] for k in (1, 4, 5)] == [[5, 2, 0, 0], [2, 1, 0, 0], [1, 1, 0, 0]]


def test_only_rows_that_meet_another_class_go_on():
    """Rows 11 and 13 have the same first minima and differ in class; 12 and 15 do too but are of one class."""
    points = np.random.default_rng(5).integers(0, 256, (6, minhash.FIRST)).astype(np.uint8)
    points[3], points[5] = points[1], points[2]
    same = {"block": 0, "sig": 9, "i": 0, "j": 0, "n": 50}
    own = {"h1": [10, 11, 12, 13, 14, 15], "comp": [1, 2, 3, 4, 5, 3], "inner": [True, True, True, False, False, False], "point": [p.tobytes() for p in points]}
    cells = pa.table({**{c: [v] * 6 for c, v in same.items()}, **own})
    assert minhash._meeting(cells).column("h1").to_pylist() == [11, 13]


def test_small_and_large_components_agree(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(20)] + [(40, 41), (41, 45), (60, 60), (None, 3)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = []
    for small in (0, 1000):
        monkeypatch.setattr(components, "SMALL", small)
        got.append(sorted(map(tuple, components.components(frame).collect())))
    assert got[0] == got[1] == [(k, 0) for k in range(21)] + [(40, 40), (41, 40), (45, 40)]
