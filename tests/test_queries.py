"""Every registered query runs; where SQL can express it, it gives the oracle's rows."""

import pytest

from quillspark import catalogue

from .oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    rows = rows_of(frame.columns, frame.collect())
    if name in catalogue.ORACLES:
        columns, wanted = oracle_rows(catalogue.ORACLES[name], sf_dir)
        assert sorted(frame.columns) == columns
        assert rows == wanted
