"""The filter audit against plain loops over documents and orders."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest

from panelforge.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, part int, fails string"
LABELS = "doc_id bigint, quality int, toxic int"


def fails(rows, k) -> set[str]:
    i, text = rows[k][0], rows[k][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == text for r in rows),
    }
    return {f for f, bad in found.items() if bad}


def expected(rows, labels):
    out = {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = [fails(rows, k) for k in range(len(rows))]
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in failed[k]]
                left = [k for k in left if f not in failed[k]]
                redundant = sum(f in failed[k] for k in own) - len(gone)
                unique = sum(failed[k] == {f} for k in own)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
                total[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("spread, carried", [(2048, 10_000), (2, 10_000), (2, 3)])
def test_audit_equals_plain_loops(spark, tables, monkeypatch, spread, carried):
    rnd = random.Random(spread)
    words = lambda n, kinds: " ".join(f"w{rnd.randint(0, kinds)}" for _ in range(n))
    texts = [None, "", " \n", "A B C $", words(120, 10**6), words(120, 20), words(150, 10**6).upper(), "x | " + words(130, 10**6), " " + words(99, 10**6), "é" * 50 + "ABCDE", "long words " * 20_000]
    rows = [(k, rnd.choice(texts), rnd.choice(["en", "de", None, ""]), 1, "x") for k in rnd.sample(range(1000), 60)]
    rows += [(None, texts[4], "en", 1, "x"), (None, texts[4], "en", 1, "x"), (5000, texts[5], "fr", 1, "x"), (5000, texts[5], "fr", 1, "x"), (5001, "only here", "fr", 1, "x"), (5001, "only here", "fr", 1, "x")]
    rows += [(-5, texts[7], "en", 1, "x")] * 2
    labels = [(r[0], rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for r in rows[::2]] + [(rows[0][0], 1, 0), (None, 1, 1), (99_999, 1, 1)]
    where = tables(documents=(rows, DOCS), labels=(labels, LABELS))
    monkeypatch.setattr(filter_audit, "SPREAD", spread)
    monkeypatch.setattr(filter_audit, "CARRIED", carried)
    monkeypatch.setattr(filter_audit.copies, "__defaults__", (spread,))
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.op12_filter_audit(spark, where).collect()}
    assert got == expected(rows, labels)


def test_empty_tables(spark, tables):
    where = tables(documents=([], DOCS), labels=([], LABELS))
    assert filter_audit.op12_filter_audit(spark, where).count() == 0


def test_copies_meet_on_exact_text_and_not_on_hashes_alone(spark, monkeypatch):
    """All hashes equal: texts still part the groups."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "text_key", lambda text: [F.lit(1).cast("bigint").alias("k1"), F.length(text).cast("bigint").alias("k2")])
    docs = spark.createDataFrame([(3, "ab", "x"), (1, "ba", "x"), (2, "ab", "x"), (4, "ba", None), (9, "abc", "x")], "doc_id bigint, text string, lang string")
    facts = docs.select("doc_id", *filter_audit.text_key(docs["text"]))
    assert sorted(r["doc_id"] for r in filter_audit.copies(docs, facts, 1).collect()) == [3, 4]
