"""Every stage of the pipeline against what brute force leaves of its input, with columns named like those that stages make, and on empty tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import language, secrets
from panelforge.llm.common import bounded_batches
from tests.llm import cases

#: Names that the stages use for their own columns.
CLASHING = ["row", "own", "found", "found_", "n", "component_id", "k1", "k2", "h1", "h2", "n_words", "n_hit", "items", "label", "spans", "shingles", "contamination", "again", "id", "_language", "_own", "_key", "_facts", "_hit", "_rest", "_changed", "_secrets", "_secrets_0", "_secrets_runs", "ids_le", "decoded", "n_tokens", "a.b"]


@pytest.fixture(scope="module")
def given(spark, sf_dir, tmp_path_factory):
    """Awkward documents and those of the smallest table, with clashing columns."""
    path = str(tmp_path_factory.mktemp("stages"))
    texts = cases.awkward() + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    benchmark = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})
    docs.write.parquet(f"{path}/documents.parquet")
    bounded_batches(spark)
    return spark.read.parquet(f"{path}/documents.parquet"), texts, benchmark, path


def stage(name, spark, given, docs=None):
    return dict(corpus_pipeline.STAGES)[name](spark, given[0] if docs is None else docs, given[3])


def same_columns(out, given):
    assert out.columns == given[0].columns
    assert all(r["a.b"] == "kept a.b" and r["row"] == "kept row" for r in out.select("`a.b`", "row").limit(5).collect())


def test_language(spark, given):
    docs, texts, *_ = given
    out = stage("language", spark, given)
    same_columns(out, given)
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    found = docs.select("doc_id", language.identify(F.col("text"), language.learned(docs), spark).alias("f")).select("doc_id", "f.*").collect()
    assert ids == {r["doc_id"] for r in found if r["lang"] != language.NONE and r["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    assert {i for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")}.isdisjoint(ids) and len(ids) > 0.9 * len(texts)


def test_near_duplicates(spark, given):
    docs, texts, *_ = given
    out = stage("near_duplicates", spark, given, docs.union(docs.where("doc_id in (10, 11)")))
    same_columns(out, given)
    classes = cases.linked(list(enumerate(texts)))
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(i for i, (_, c) in classes.items() if c == i)


def test_near_copies_with_one_id_or_none(spark, given):
    """Three near copies: one row stays, the same one whatever the order of the rows."""
    text = " ".join(f"w{k}" for k in range(60))
    texts = [text, text + " x", text + " y"]
    docs = given[0].limit(1)
    row = lambda i, t, s: docs.withColumns({"doc_id": F.lit(i).cast("bigint"), "text": F.lit(t), "source": F.lit(s)})
    for ids in ((None, None, None), (7, 7, 7), (7, 8, 9), (9, None, 7), (None, None, 8)):
        found = set()
        for order in ((0, 1, 2), (2, 1, 0)):
            frames = [row(ids[k], texts[k], f"s{k}") for k in order]
            kept = stage("near_duplicates", spark, given, frames[0].union(frames[1]).union(frames[2]).union(frames[0])).collect()
            assert len(kept) == 1 and kept[0]["doc_id"] == min((i for i in ids if i is not None), default=None)
            found.add((kept[0]["text"], kept[0]["source"]))
        assert len(found) == 1
    # One text and id, other columns: still one row.
    assert stage("near_duplicates", spark, given, row(1, text, "a").union(row(1, text, "b"))).count() == 1


def test_benchmark_leaks(spark, given):
    _, texts, benchmark, _ = given
    out = stage("benchmark_leaks", spark, given)
    same_columns(out, given)
    hit = cases.contamination([t or "" for t in texts], benchmark)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [i for i, (_, n, _) in enumerate(hit) if not n]


def test_secrets(spark, given):
    docs, texts, *_ = given
    out = stage("secrets", spark, given)
    same_columns(out, given)
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs.select("doc_id", "text"), secrets.fit(docs)).collect()}
    got = {r["doc_id"]: r for r in out.select("doc_id", "text", "n_chars").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = sorted((s["start"], s["end"]) for s in found[i])
        base = sorted(s for v in cases.base_secrets(t or "").values() for s in v)
        assert set(base) <= set(spans)
        left, at = "", 0
        for a, b in spans:
            left += (t[at:a] + corpus_pipeline.REDACTED) if a >= at else ""
            at = max(at, b)
        expected = t if not spans else left + t[at:]
        assert got[i]["text"] == expected and (not spans or got[i]["n_chars"] == len(expected))


def test_tokens(spark, given):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    _, texts, *_ = given
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in stage("tokens", spark, given).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == cases.sha(library.decode(ids, skip_special_tokens=False))


def test_nulls_in_any_column_and_empty_tables(spark, given):
    docs = given[0]
    nulls = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    for name, _ in corpus_pipeline.STAGES:
        assert stage(name, spark, given, docs.limit(0)).count() == 0
        out = stage(name, spark, given, nulls.union(nulls))
        assert out.count() == {"language": 0, "near_duplicates": 1}.get(name, 2)


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "near", "benchmark", "secrets", "tokens"]
