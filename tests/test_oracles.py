"""Every registered query of the library against its DuckDB SQL."""

import os

import pytest
from quillwright import registry

from compare import both, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        df = registry.queries()[name](spark, FOLDER)
        assert df.columns and df.inputFiles()
        return
    (names, got), (wanted_names, want) = both(spark, FOLDER, registry.queries()[name], sql, con)
    assert names == wanted_names
    assert got == want
