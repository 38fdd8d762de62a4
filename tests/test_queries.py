"""Every registered query with a SQL counterpart against DuckDB; the others must run."""

import pytest

from paperloom.queries import QUERIES, SQL
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert difference(spark, QUERIES[name], SQL[name], FOLDER) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_counterpart_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
