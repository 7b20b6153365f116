"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from fluvigrid.plans import catalogue

from oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], sf)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
