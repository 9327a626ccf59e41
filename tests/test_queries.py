"""Every query against its DuckDB SQL."""

import pytest

from quillspark.catalog import ORACLE_SQL, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert not differences(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)[:3]
