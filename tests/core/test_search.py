"""Semantic search: scores are made in blocks of queries."""

from entigraph.operators import search


def test_queries_go_in_blocks_with_the_same_result(spark, monkeypatch):
    """A block never holds more than it may, whatever the number of queries."""
    v = spark.range(120).selectExpr("id AS vec_id", "array(cast(sin(id) as float), cast(cos(id * 2) as float), cast(1.5 as float)) AS embedding")
    whole = sorted(map(tuple, search.semantic(v, v, -1.0, k=3).selectExpr("query_id", "vec_id", "round(score, 9)").collect()))
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 7)
    got = sorted(map(tuple, search.semantic(v, v, -1.0, k=3).selectExpr("query_id", "vec_id", "round(score, 9)").collect()))
    assert got == whole and len(got) == 360
