"""The secret models: plain Python scorer, keys that stand alone in the table, from once to many times."""

from __future__ import annotations

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import secrets
from tests.llm import cases

WORDS = "alpha beta river stone garden market window yellow simple number quick winter letter system table forest".split()


def markov_spans(text: str, model: list[float]) -> list[tuple[int, int]]:
    """Spans that the models add, by plain loops over regular expressions."""
    place = lambda c: secrets.ALPHABET.find(c) + 1
    base = sorted(s for v in cases.base_secrets(text).values() for s in v)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        at, left = m.start(), []
        for a, b in base:
            if a < m.end() and m.start() < b:
                left.append((at, a))
                at = max(at, b)
        for a, b in [*left, (at, m.end())]:
            parts = [p for p in re.split("[-_/]", text[a:b]) if len(p) >= secrets.PART] if b - a >= secrets.RUN else []
            ratios = [model[place(x) * secrets.WIDTH + place(y)] for p in parts for x, y in zip(p, p[1:], strict=False)]
            if ratios and math.fsum(ratios) >= secrets.THRESHOLD * len(ratios):
                out.append((a, b))
    return sorted(out)


def test_spans_of_the_models_equal_a_plain_scorer(spark, sf_dir):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits + "-_/") for _ in range(n))
    texts = cases.awkward() + [f"see {text(rnd.randint(18, 60))} and {text(24)}+0123456789abcdef0123+{text(25)} end" for _ in range(80)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(cases.documents(texts), cases.SCHEMA)
    model = secrets.fit(docs)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(docs, model).select("doc_id", "spans").collect()}
    expected = {i: markov_spans(t or "", model) for i, t in enumerate(texts)}
    assert got == expected and sum(map(len, expected.values())) > 80


@pytest.mark.parametrize("copies", [1, 10, 100])
def test_keys_that_stand_in_the_table_are_found_however_often(spark, copies):
    """Keys without a base match, in the table that the models learn from, beside prose, identifiers and a few labelled secrets."""
    rnd = random.Random(copies)
    key = lambda: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(rnd.randint(24, 40)))
    keys = [key() for _ in range(100)]
    plain = ["".join(rnd.choice(WORDS).title() for _ in range(4)) for _ in range(150)] + ["_".join(rnd.choice(WORDS) for _ in range(5)) for _ in range(150)]
    prose = [" ".join(rnd.choice(WORDS) + rnd.choice(["ing", "ful", "ness", ""]) for _ in range(60)) for _ in range(200)]
    texts = [f"token={key()}" for _ in range(60)] + [f"see {k} there" for k in keys * copies] + [f"call {p} now" for p in plain] + prose
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = secrets.scan(docs, secrets.fit(docs)).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == 3)).alias("n")).collect()
    hit = {r["doc_id"] for r in found if r["n"]}
    wanted = set(range(60, 60 + 100 * copies))
    assert len(hit & wanted) > 0.9 * len(wanted) and len(hit - wanted) < 0.1 * len(hit & wanted) / copies
    clean = corpus_pipeline.redacted(spark, docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")}), "")
    left = {r["doc_id"] for r in clean.where(~F.col("text").contains(corpus_pipeline.REDACTED)).collect()}
    assert len(left & wanted) < 0.1 * len(wanted) and len(left) >= len(plain) + len(prose) - 10
