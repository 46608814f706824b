"""Registered queries of the library: name -> (query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("clean", "score", "wider_scores", "portfolios", "tests_and_fits", "series_and_weights", "multivariate", "more_tests", "wider_analysis", "small_tables", "peers", "monotone", "intervals", "validation", "proxies", "round_trips", "full_counts", "provenance")


def registered() -> dict:
    """All queries. ``round(`` in the SQL gets the same nudge off halfway points as the queries' results (``ROUND(`` is left alone)."""
    out = {}
    for name in MODULES:
        module = import_module(f"panelforge.plans.{name}")
        out |= {n: (query, sql and sql.replace("round(", "round(1.0000000000001::DOUBLE * ")) for n, (query, sql) in module.QUERIES.items()}
    return out
