"""Chunks of entities are dealt evenly to files, and numbers by the shortened digest are those of hashlib."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from panelforge.functions.uniforms import uniforms
from panelforge.operators import rank_intervals


def test_no_file_holds_more_chunks_than_its_share(spark):
    dealt = rank_intervals._dealt(spark.range(16).select(F.col("id").cast("int").alias("chunk")))
    held = [r["count"] for r in dealt.groupBy(F.input_file_name()).count().collect()]
    assert sorted(held) == [4, 4, 4, 4]


def test_numbers_of_messages_with_shared_and_own_words():
    for keys in (["7"], ["7", "8", "123456789"], ["abcdefgh" * 5, "abcdefgi" * 5]):
        got = uniforms(42, range(98, 103), keys)
        assert np.array_equal(got, [[int(hashlib.md5(f"42|{r}|{k}".encode()).hexdigest()[:8], 16) / 2**32 for r in range(98, 103)] for k in keys])
