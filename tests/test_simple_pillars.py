"""Plain pillar means: absent columns, missing sources, clipping."""

from __future__ import annotations

import pytest

from panelforge.operators import scoring


def test_simple_pillars(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 90.0, 100.0), (2, None, 4.0, None, None), (3, None, None, 100.0, 100.0)], "id int, a double, b double, c double, d double")
    sources = [(1, "c", "real_sec"), (1, "d", "missing"), (1, "a", "real_epa"), (2, "c", "sector_imputed"), (2, "a", "financial_proxy"), (3, "c", "real_sec"), (3, "d", "real_sec"), (3, "a", "elsewhere")]
    frame = spark.createDataFrame(sources, "id int, column string, source string")
    got = {r["id"]: r for r in scoring.simple_pillars(df, "id", {"x": ["a", "b", "absent"], "y": ["c", "d"], "z": ["absent"]}, frame, "y").collect()}
    assert [got[i]["x"] for i in (1, 2, 3)] == [15.0, 4.0, None] and all(got[i]["z"] is None for i in got)
    # Half of the cells filed lifts by 1.0, all by 1.1 up to the limit, none cuts by 0.9; without values the pillar starts from 50.
    assert [got[i]["y"] for i in (1, 2, 3)] == pytest.approx([95.0, 45.0, 100.0])
    assert [got[i]["source"] for i in (1, 2, 3)] == ["real_epa", "proxy_calibrated", "real_sec"]
    alone = scoring.simple_pillars(df, "id", {"x": ["a"], "y": ["absent"]}, frame.limit(0), "y").collect()
    assert {r["source"] for r in alone} == {"imputed"} and all(r["y"] is None for r in alone)
