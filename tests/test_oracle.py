from __future__ import annotations

import pytest
from compare import canonical, connect, duck_rows, spark_rows

from __spark_entry__ import entry, oracle_sql, queries
from cladewise.catalog import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert QUERIES.keys() <= oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    names, rows = spark_rows(queries()[name](spark, sf_dir))
    duck_names, expected = duck_rows(duck, oracle_sql()[name])
    assert sorted(names) == sorted(duck_names)
    assert canonical(names, rows) == canonical(duck_names, expected)
    assert rows, "a comparison of nothing shows nothing"


def test_entry_runs(spark, sf_dir):
    assert entry(spark).limit(1).count() == 1
