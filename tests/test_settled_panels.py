"""Queries that read their panel in several passes join orders and lines once."""

from __future__ import annotations

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["out_consensus", "imp_group_median", "scr_shrunk", "corr_shrunk"])
def test_result_reads_no_lines_again(spark, sf_dir, name):
    files = __spark_entry__.queries()[name](spark, sf_dir).inputFiles()
    assert files and not any("lineitem.parquet" in f for f in files)
