import glob
import os

import duckdb
import pytest

from loomspan.llm.queries import QUERIES, SQL
from tests.test_queries import cell

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": [("session_id", "string"), ("turn_no", "int"), ("id", "string"), ("speaker", "string")], "p7_found": [("table_name", "string"), ("row_id", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint"), ("pii_kind", "string"), ("pii_text", "string")],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        if name.endswith("_found"):
            assert len(set(rows)) == len(rows) and all(v is not None for r in rows for v in r)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == theirs
