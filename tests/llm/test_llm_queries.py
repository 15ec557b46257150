"""The registered text queries run on the smallest tables with the columns the driver expects."""

import pytest
from siteloom.llm import queries

COLUMNS = {"p1_found": ["field", "record_id"], "p2_found": ["capture_id", "line_no"], "p5_found": ["capture_id_a", "capture_id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    n = df.count()
    if name.endswith("_found"):
        assert n == df.distinct().count()
