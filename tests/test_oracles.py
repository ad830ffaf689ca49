"""Corpus queries against equal SQL, and that the others give rows."""

import compare
import pytest
from lexispark import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
SLOW = {"l01_train_embeddings", "m01_train_topics", "m02_infer_topics"}


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, sf, name):
    compare.same(spark, con, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - SLOW))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
