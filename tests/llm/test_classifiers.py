"""Held-out accuracy of the trained models, and their results on awkward tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from panelforge.llm import language, quality, toxicity
from tests.conftest import DATA
from tests.llm import cases

LARGER = str(DATA / "sf0.01")


def scored(spark, query, column):
    rows = query(spark, LARGER).collect()
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{LARGER}/{'documents' if column == 'lang' else 'labels'}.parquet").collect()}
    return [(r, truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth], rows


def test_toxicity(spark):
    held, rows = scored(spark, toxicity.op1_toxicity, "toxic")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.93
    assert np.mean([r["predicted"] for r, y in held if y == 0]) < 0.03


def test_quality(spark):
    held, rows = scored(spark, quality.op10_quality, "quality")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.93


def test_language(spark):
    held, rows = scored(spark, language.op5_language, "lang")
    assert np.mean([r["lang_pred"] == y for r, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_and_empty_tables(spark, tables):
    texts = cases.awkward()
    docs = cases.documents(texts) + cases.documents(["repeated row"] * 2, start=500) + [(None, "no id", None, None, None, "", "", 0, 0.0)]
    labels = [(i, i % 2, None if i == 3 else i % 3 // 2) for i in range(12)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (999, 1, 1)]
    where = tables(documents=(docs, cases.SCHEMA), labels=(labels, "doc_id bigint, quality int, toxic int"))
    for query in (toxicity.op1_toxicity, quality.op10_quality, language.op5_language):
        rows = query(spark, where).collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (500, 501)}) == 1
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert {found[i] for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")} == {language.NONE}


def test_tables_without_rows(spark, tables):
    where = tables(documents=([], cases.SCHEMA), labels=([], "doc_id bigint, quality int, toxic int"))
    for query in (toxicity.op1_toxicity, quality.op10_quality, language.op5_language):
        assert query(spark, where).count() == 0


def test_whole_texts_count():
    text = "plain words " * 50_000
    a, b = quality.statistics(pa.array([text, text + "odd! "]))
    assert not np.allclose(a, b)
    long, longer = (next(iter(toxicity._distinct(pa.array([t])))) for t in (text, text + "last"))
    assert len(longer) > len(long)
