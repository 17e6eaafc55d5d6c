import os

import pytest

from compare import compare, duck
from tessera.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(DATA), DATA, QUERIES[name], ORACLES[name]) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name,columns", [("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id", "subject"]), ("p8_containers", ["container", "position", "doc_id", "piece", "first_token", "n_tokens"])])
def test_columns(spark, name, columns):
    assert QUERIES[name](spark, DATA).columns == columns
