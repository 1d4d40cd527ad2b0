"""Runs of steps: all inputs are used, a rerun does what changed, a failure stops its own subtree."""

import pytest

from entigraph.plans.pipeline import Step, resume


@pytest.fixture
def made(tmp_path, spark):
    spark.range(5).selectExpr("id AS doc_id", "concat('text ', id, '. More here.') AS text").write.parquet(f"{tmp_path}/a")
    spark.range(5, 8).selectExpr("id AS doc_id", "concat('text ', id, '.') AS text", "'x' AS extra").write.parquet(f"{tmp_path}/b")
    return tmp_path


def steps(folder, size=1000, statement="SELECT count(*) AS n FROM {chunk}"):
    return [
        Step("a", "read_documents", config={"path": f"{folder}/a"}),
        Step("b", "read_documents", config={"path": f"{folder}/b"}),
        Step("chunk", "text_chunking", ("a", "b"), config={"chunk_size": size, "overlap": 10}),
        Step("count", "sql", ("chunk",), config={"statement": statement}),
        Step("profile", "data_profiling", ("b",)),
        Step("off", "nothing", enabled=False),
    ]


def test_resume(spark, made):
    out = f"{made}/out"
    by = lambda runs: {r.step_id: r.status for r in runs}
    first = resume(spark, steps(made), out, "1")
    assert by(first) == dict.fromkeys(("a", "b", "chunk", "count", "profile"), "completed")
    assert [r.level for r in first] == [0, 0, 1, 1, 2]
    path = {r.step_id: r.path for r in first}
    assert spark.read.parquet(path["count"]).first().n == 8  # both inputs
    assert by(resume(spark, steps(made), out, "2")) == dict.fromkeys(path, "kept")
    # a setting changes: that step and those after it
    third = by(resume(spark, steps(made, size=500), out, "3"))
    assert third == {"a": "kept", "b": "kept", "profile": "kept", "chunk": "completed", "count": "completed"}
    # a file is added
    spark.range(9, 10).selectExpr("id AS doc_id", "'new' AS text").write.mode("append").parquet(f"{made}/a")
    fourth = resume(spark, steps(made), out, "4")
    assert by(fourth) == {"a": "completed", "b": "kept", "profile": "kept", "chunk": "completed", "count": "completed"}
    assert spark.read.parquet({r.step_id: r.path for r in fourth}["count"]).first().n == 9
    told = {(r.run_id, r.step_id): r.status for r in spark.read.json(f"{out}/_runs/*").collect()}
    assert len(told) == 20 and told["4", "a"] == "completed"


def test_failure_stops_its_own_subtree(spark, made):
    out = f"{made}/out"
    bad = [*steps(made, statement="SELECT nothing FROM {chunk}"), Step("after", "sql", ("count", "profile"), config={"statement": "SELECT count(*) AS n FROM {count}"}), Step("odd", "unheard", ("a",))]
    runs = {r.step_id: r for r in resume(spark, bad, out, "1")}
    assert {k: r.status for k, r in runs.items()} == {"a": "completed", "b": "completed", "chunk": "completed", "profile": "completed", "count": "failed", "after": "skipped", "odd": "failed"}
    assert "nothing" in runs["count"].error and runs["after"].error == "needs count"
    good = [*steps(made), bad[-2]]
    assert {r.step_id: r.status for r in resume(spark, good, out, "2")} == {"a": "kept", "b": "kept", "chunk": "kept", "profile": "kept", "count": "completed", "after": "completed"}
