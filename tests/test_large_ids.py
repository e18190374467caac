"""Queries against their SQL on ids of many digits."""

import duckdb

from quern.plans.catalogue import ORACLES, QUERIES


def test_record_ids_of_many_digits(spark, tmp_path):
    rows = [(7, "a"), (99_999, "a"), (100_000, "b"), (123_456, "b"), (1_234_567, "c"), (12_345_678, None), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ours = [tuple(r) for r in QUERIES["record_ids"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(ours, key=str) == sorted(con.execute(ORACLES["record_ids"]).fetchall(), key=str)


def test_simhash_of_repeated_and_null_ids(spark, tmp_path):
    words = ["one two three four five six", "one two", "", None, "six six seven", "\u00e9t\u00e9 two", "one two three four five six seven"]
    rows = [(k % 9 if k < 12 else None if k < 15 else k, words[k % 7], "src", "en") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("simhash",):
        ours = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        theirs = con.sql(ORACLES[name])
        order = [theirs.columns.index(c) for c in QUERIES[name](spark, str(tmp_path)).columns]
        assert sorted(map(str, ours)) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())
