import pytest

from entigraph.functions import tables


def test_first_rows(spark):
    tables.register(spark)
    spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, None), ("b", 5, "z"), (None, 1, "n")], "k string, v int, t string").createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT * FROM first_rows(TABLE(some_rows) PARTITION BY k ORDER BY v DESC, n => 2)")
    assert got.columns == ["k", "v", "t", "place"]
    assert {tuple(r) for r in got.collect()} == {("a", 3, "x", 1), ("a", 2, None, 2), ("b", 5, "z", 1), (None, 1, "n", 1)}
    assert spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM some_rows WHERE v > 9) PARTITION BY k ORDER BY v, n => 2)").count() == 0
    for bad in ("TABLE(some_rows), 0", "TABLE(some_rows), CAST(NULL AS INT)", "3, 3", "TABLE(SELECT 1 AS place), 1"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM first_rows({bad})").collect()


def test_permissions(spark):
    tables.register(spark)
    rows = [(1, "docs:read"), (1, "docs:read"), (1, "docs:write"), (2, "all"), (2, None)]
    spark.createDataFrame(rows, "user_id int, name string").createOrReplaceTempView("some_grants")
    got = spark.sql("SELECT * FROM permissions_of(TABLE(some_grants) PARTITION BY user_id)")
    assert sorted(map(tuple, got.collect())) == [(1, "docs", "read"), (1, "docs", "write"), (2, "all", "")]
