"""Training-data queries that SQL can express, against their SQL; the others for shape and repeatability."""

import pytest

from loamgraph.llm import queries
from oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    same(spark, FOLDER, queries.QUERIES, queries.SQL, name)


FOUND = {"p1_found": ["file_no"], "p2_found": ["file_a", "file_b"], "p4_found": ["summary_a", "summary_b"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
