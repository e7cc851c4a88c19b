"""Queries over every source's lines and files against their SQL."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", ["x01_each_file_once", "x07_all_files_once", "c10_trim_all", "c11_line_number_all"])
def test_all_sources(spark, sf, duck, name):  # noqa: F811
    df = queries()[name](spark, sf)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert mine == sorted(repr([plain(r[cols.index(c)]) for c in names]) for r in rel.fetchall()) and mine
    if name != "x01_each_file_once":
        at = names.index("batch_id")
        assert {eval(m)[at][:5] for m in mine} == {"plt01", "plt02", "plt03"}
