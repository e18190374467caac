import glob
import os

import duckdb
import pytest

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in order]
    assert sorted(str(tuple(r)) for r in ours.select(*order).collect()) == sorted(str(tuple(r[i] for i in place)) for r in theirs.fetchall())
