"""Edges: what is shuffled of them, and what joins them."""

from entigraph import fixtures
from entigraph.operators import ontology, resolve
from entigraph.plans import more, reads


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_made_distinct_as_numbers(spark, sf_dir):
    by = [x.split("Aggregate [")[1].split("]")[0] for x in plan(fixtures.relationships(spark, sf_dir)).splitlines() if "Aggregate [" in x]
    assert len(by) == 5 and not any("concat(" in x or "entity_id" in x for x in by)


def test_types_without_a_rule_are_not_joined(spark, sf_dir):
    shape = "relationship_type string, source_types array<string>, target_types array<string>"
    allowed = spark.createDataFrame([("LOCATED_IN", ["CUSTOMER"], []), ("PURCHASED", [], [])], shape)
    found = ontology.endpoint_violations(fixtures.relationships(spark, sf_dir), fixtures.entities(spark, sf_dir), allowed)
    assert "lineitem" not in plan(found) and "l_partkey" not in plan(found)
    assert {r.source_type for r in found.collect()} == {"COUNTRY", "ORGANIZATION"}
    none = spark.createDataFrame([("LOCATED_IN", [], [])], shape)
    assert ontology.endpoint_violations(fixtures.relationships(spark, sf_dir), fixtures.entities(spark, sf_dir), none).count() == 0


def test_only_edges_of_the_loser_are_joined(spark):
    rows = [("1", "a", "L", "K", True), ("2", "a", "W", "K", True), ("3", "b", "L", "K", True), ("4", "L", "W", "K", True), ("5", "x", "y", "K", True), ("6", None, "y", "K", True), ("7", "x", None, "K", False)]
    edges = spark.createDataFrame(rows, "id string, source_entity_id string, target_entity_id string, relationship_type string, is_active boolean")
    moved = resolve.transfer_edges(edges, "L", "W")
    assert {tuple(r) for r in moved.collect()} == {("1", "a", "L", "K", False), ("2", "a", "W", "K", True), ("3", "b", "W", "K", True), ("4", "L", "W", "K", False), *rows[4:]}
    assert plan(moved).lstrip().startswith("Union")


def test_pairs_are_distinct_before_they_are_joined(spark, sf_dir):
    lines = plan(reads.d19(spark, sf_dir)).splitlines()
    assert any("RepartitionByExpression [l_suppkey" in x for x in lines)
    assert not any("Aggregate [s_suppkey" in x and "count" in x for x in lines)


def test_ids_are_made_after_the_joins_of_endpoints(spark, sf_dir):
    first, *below = plan(more.d08(spark, sf_dir)).split("Join")
    assert "concat_ws" in first and not any("concat_ws" in x for x in below)
