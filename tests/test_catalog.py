"""Every query of the catalogue gives the rows of its SQL."""

from __future__ import annotations

import pytest
from oracles import same_rows

import __spark_entry__
from quire import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_rows(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["paper_id", "ref_id", "n_citations", "n_sections"] and out.count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
