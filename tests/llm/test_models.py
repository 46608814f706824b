"""Trained models against plain loops, kernels on segments against whole texts, and precision and recall of the secret models."""

from __future__ import annotations

import math
import random
import string

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import bpe, fingerprint, language, ngram_join, quality, secrets, suffix_dedup, text_kernels, toxicity
from panelforge.llm.common import training_rows
from tests.llm import cases


def test_one_shard_of_ftrl_equals_a_plain_loop():
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 40, rnd.integers(0, 12))).astype(np.int32) for _ in range(120)]
    labels = (np.array([7 in r or 11 in r for r in rows]) ^ (rnd.random(120) < 0.1)).astype(float)
    start = toxicity.State(np.array([3, 7, toxicity.BIAS]), np.array([0.4, -2.5, 0.3]), np.array([1.0, 4.0, 9.0]))
    new = toxicity.train_shard(rows, labels, start, 1.5)
    z, n = {3: 0.4, 7: -2.5, "bias": 0.3}, {3: 1.0, 7: 4.0, "bias": 9.0}
    seen = {b: sum(b in r for r in rows) for b in range(40)}
    used = {b for b in seen if seen[b] >= 1.5} | {3, 7, "bias"}

    def weight(b):
        l1 = 0 if b == "bias" else 1.5
        if abs(z.get(b, 0.0)) <= l1:
            return 0.0
        return -(z[b] - math.copysign(l1, z[b])) / ((1.0 + math.sqrt(n.get(b, 0.0))) / 1.0)

    for row, y in zip(rows, labels, strict=True):
        on = [b for b in [*row.tolist(), "bias"] if b in used]
        w = {b: weight(b) for b in on}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for b in on:
            before = n.get(b, 0.0)
            z[b] = z.get(b, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) * w[b]
            n[b] = before + g * g
    names = ["bias" if b == toxicity.BIAS else int(b) for b in new.buckets]
    assert dict(zip(names, new.z, strict=True)) == pytest.approx({b: z.get(b, 0.0) for b in names})
    assert dict(zip(names, new.n, strict=True)) == pytest.approx({b: n.get(b, 0.0) for b in names})
    both = toxicity.averaged([new, toxicity.State(np.array([7]), np.array([1.5]), np.array([2.0]))], start)
    at = both.buckets.tolist().index(3)
    assert both.z[at] == pytest.approx((z[3] + 0.4) / 2)


def test_language_scores_equal_a_plain_version(spark):
    model = language.fit(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20)], "doc_id bigint, text string, lang string"))
    buckets, values, _ = next(iter(language.vectors(pa.array(["und die Katze the"]), model.idf)))
    logits = [(sum(v * model.weights[b, k] for b, v in zip(buckets, values, strict=True)) + model.weights[-1, k]) / model.temperature for k in range(2)]
    best = max(range(2), key=logits.__getitem__)
    expected = 1 / sum(math.exp(x - logits[best]) for x in logits)
    frame = spark.createDataFrame([("und die Katze the",)], "text string")
    got = frame.select(language.identify(frame["text"], model, spark).alias("f")).head()["f"]
    assert got["lang"] == model.names[best] and got["score"] == pytest.approx(expected)
    counts = dict(zip(*next(iter(language.vectors(pa.array(["abAB"]))))[:2], strict=True))
    assert sum(counts.values()) == 4 + 3 + 2 and len(counts) <= 2 + 2 + 2


def test_rare_languages_are_learned(spark):
    rows = [(i, f"common words number {i} of them", "en") for i in range(3000)] + [(10_000 + i, f"hapax legomenon {i} xyzzy", "xx") for i in range(5)]
    sample, names = language.sampled(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 200)
    found = [r["label"] for r in sample.collect()]
    assert names == ["en", "xx"] and found.count("xx") == 5 and len(found) <= 200


def test_rows_learned_from_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (None, 1), (1, None)], "doc_id bigint, label int")
    got = training_rows(docs, labels, 50).collect()
    assert len(got) == 50 and got[0].asDict().keys() == {"text", "label"}
    assert training_rows(docs, labels.limit(0), 50).count() == 0


def test_flat_trees_equal_a_recursive_walk():
    rnd = np.random.default_rng(5)
    x = rnd.random((300, 6))
    y = (x[:, 2] + 0.2 * rnd.random(300) > 0.6).astype(float)
    forest = quality.grow(x, y)

    def walk(tree, node, row):
        k = forest.statistic[tree, node]
        return forest.value[tree, node] if k < 0 else walk(tree, 2 * node + 1 + int(row[k] > forest.threshold[tree, node]), row)

    expected = [forest.base + sum(walk(t, 0, row) for t in range(len(forest.statistic))) for row in x[:40]]
    assert forest.logits(x[:40]) == pytest.approx(expected)
    # The first split is the one that exhaustive search finds.
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda s: s[0] ** 2 / (s[1] + quality.L2)
    best = max(
        ((gain((g[x[:, k] <= c].sum(), h[x[:, k] <= c].sum())) + gain((g[x[:, k] > c].sum(), h[x[:, k] > c].sum())), k, c) for k in range(6) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1])) if min((x[:, k] <= c).sum(), (x[:, k] > c).sum()) >= quality.LEAST),
    )
    assert (forest.statistic[0, 0], forest.threshold[0, 0]) == (best[1], pytest.approx(best[2]))


def test_likeness_is_near_the_cosine_of_word_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(5))
    base = [word() for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k, share in enumerate((0.0, 0.25, 0.5, 1.0), 1):
        rows.append((k, " ".join(base[int(400 * share) :] + [word() for _ in range(int(400 * share))])))
    lanes = {r["k"]: r["lanes"] for r in fingerprint.fingerprints(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    frame = spark.createDataFrame([(k, lanes[0], lanes[k]) for k in lanes], "k int, a array<bigint>, b array<bigint>")
    got = {r["k"]: r["s"] for r in frame.select("k", fingerprint.likeness(frame["a"], frame["b"]).alias("s")).collect()}
    assert got[0] == 1.0 and got[1] == 1.0 and 0.35 < got[3] < 0.8 and got[2] > got[3] > got[4]


def secret_and_ordinary(seed: int = 8):
    rnd = random.Random(seed)
    words = "alpha beta river stone garden market window yellow simple number quick winter letter system table forest".split()
    letters = string.ascii_letters + string.digits
    secret = ["".join(rnd.choice(letters) for _ in range(rnd.randint(20, 40))) for _ in range(800)]
    ordinary = ["".join(rnd.choice(words) for _ in range(5)) for _ in range(40)]
    ordinary += ["/".join(rnd.choice(words) for _ in range(5)) for _ in range(20)] + ["_".join(rnd.choice(words) for _ in range(5)) for _ in range(20)]
    ordinary += [f"20{rnd.randint(10, 24)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}-{rnd.choice(words)}-{rnd.choice(words)}" for _ in range(20)]
    return secret, ordinary


def test_precision_and_recall_of_the_secret_models(spark):
    secret, ordinary = secret_and_ordinary()
    train = [(i, f"password={s}") for i, s in enumerate(secret[:700])] + [(1000 + i, f"see {o} there") for i, o in enumerate(ordinary[::2])]
    model = secrets.fit(spark.createDataFrame(train, "doc_id bigint, text string"))
    test = [(i, s, True) for i, s in enumerate(secret[700:])] + [(1000 + i, o, False) for i, o in enumerate(ordinary[1::2])]
    found = secrets.scan(spark.createDataFrame(test, "doc_id bigint, text string, secret boolean"), model).collect()
    hit = [r["secret"] for r in found if any(s["kind"] == 3 for s in r["spans"])]
    assert sum(hit) / len(hit) > 0.95 and sum(hit) > 0.9 * len(secret[700:])


@pytest.mark.parametrize("size", [64, 300])
def test_segments_give_what_whole_texts_give(monkeypatch, size):
    """Kernels on data beyond a chunk's size, among them words longer than that."""
    rnd = random.Random(size)
    texts = ["x" * 1000 + " yz", "", " ".join(str(rnd.random()) for _ in range(300)) + "\n" + "éß中文🙂 " * 80, "abc " * 700, " ", "w" * 64 + " " + "v" * 63]
    batch = pa.array(texts)
    level = np.zeros(1 << 16, np.uint8)

    def everything():
        found = []
        for _, data, offsets in text_kernels.chunks(batch):
            w = text_kernels.Words(data, offsets)
            found.append([offsets.tolist(), w.start.tolist(), w.end.tolist(), w.hashes().tolist(), w.hashes(4).tolist(), text_kernels.gram_hashes(data, 64).tolist()])
        words = [h for f in found for h in f[3]]
        counts = [(b.tolist(), c.tolist(), bool(has)) for b, c, has in language._counts(batch)]
        return words, [s.tolist() for s in ngram_join.shingle_sets(batch)], counts, quality.statistics(batch).round(9).tolist()

    whole = everything()
    monkeypatch.setattr(text_kernels, "CHUNK_BYTES", size)
    monkeypatch.setattr(language, "CHUNK_BYTES", size)
    monkeypatch.setattr(text_kernels, "_powers", {})
    monkeypatch.setattr(text_kernels.chunks, "__defaults__", (size,))
    assert everything() == whole
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", size)
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    found = suffix_dedup.runs(data, np.array([0, len(data)]), level)
    assert found[2].sum() == len(data) - suffix_dedup.LENGTH + 1


def test_a_very_long_text():
    """Some 20 MB in one text: every kernel takes it in segments."""
    text = "long words in a very long text 123 " * 600_000
    batch = pa.array([text, "short"])
    assert [len(s) for s in ngram_join.shingle_sets(batch)] == [8, 1]
    assert len(next(iter(language._counts(batch)))[0]) < 200
    assert quality.statistics(batch).shape == (2, len(quality.STATISTICS))
    assert len(toxicity._distinct(batch)[0]) < 60
    data = np.frombuffer(text.encode()[: 4 << 20], np.uint8)
    assert suffix_dedup.runs(data, np.array([0, len(data)]), np.zeros(1 << 16, np.uint8))[2].sum() == len(data) - 199


def test_suffix_automaton_knows_all_suffixes():
    rnd = random.Random(4)
    words = {bytes([c]): c for c in b"abc"}
    while len(words) < 60:
        words.setdefault(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))), 1000 + len(words))
    fa = bpe.SuffixAutomaton(words)
    text = bytes(rnd.choice(b"abc") for _ in range(300))
    state = known = 0
    for end, byte in enumerate(text, 1):
        while (to := fa.step.get(state << 8 | byte)) is None:
            state = fa.link[state]
            known = fa.length[state]
        state, known = to, known + 1
        got, token = [], fa.longest[state]
        while token >= 0:
            if fa.size[token] <= known:
                got.append(token)
            token = fa.shorter[token]
        assert got == [words[text[k:end]] for k in range(max(0, end - 6), end) if text[k:end] in words]


def test_vocabulary_without_a_byte_is_refused(tmp_path):
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"a": 0}, "merges": []}}')
    with pytest.raises(ValueError, match="not every byte"):
        bpe.Encoder(str(tmp_path / "v.json"), bpe.piece_pattern())


def test_cases_hold_long_texts():
    assert max(len(t or "") for t in cases.awkward()) > 100_000
