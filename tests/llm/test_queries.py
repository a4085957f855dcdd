import os

import duckdb
import pytest

from auditloom.llm import queries

DATA = os.environ.get("AUDITLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.isdir(queries.TOKENIZERS), reason="no test tables")
COLUMNS = {
    "p1_found": ["audit_id", "issue_id"], "p4_found": ["record_table", "id_a", "id_b"], "p5_found": ["page_id", "block_key"], "p6_found": ["page_id"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    made = queries.QUERIES[name](spark, DATA)
    rows = made.collect()
    assert made.columns == COLUMNS.get(name, made.columns)
    assert len({str(r) for r in rows}) == len(rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{file}')")
        assert sorted(tuple(r) for r in rows) == sorted(con.sql(queries.ORACLES[name]).fetchall())
