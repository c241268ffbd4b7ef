import os

import pytest
from compare import DATA, check

from symweave.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLES.get(name))


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)
