"""Names and their keys never go through the driver."""

from __future__ import annotations

from panelforge.sources import ingest


def test_keys_and_names_are_not_broadcast(spark, capsys):
    names = spark.createDataFrame([(f"acme {i:09d}",) for i in range(30)], "_a string")
    firms = spark.createDataFrame([(f"acme {i:09d}x", f"ACME {i:09d}x Inc") for i in range(30)], "_b string, _r string")
    near = ingest._near(names, firms, 0.78, [(14, 15)])
    near.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {r["_a"]: r["_m"]["_r"] for r in near.collect()} == {f"acme {i:09d}": f"ACME {i:09d}x Inc" for i in range(30)}


def test_matched_names_are_not_broadcast(spark, capsys):
    left, right = spark.createDataFrame([(1, "Acme 12 Corp."), (2, "Zeta")], "id int, name string"), spark.createDataFrame([("ACME 12x Inc",)], "firm string")
    out = ingest.fuzzy_match(left, right, "name", "firm")
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {r["id"]: r["match"] for r in out.collect()} == {1: "ACME 12x Inc", 2: None}
