"""Streams with state by key: the decisions of a batch, over restarts, and keys that leave."""

import random

import pytest

from entigraph.streaming import limits, stateful

SCHEMA = "k string, at timestamp, n long, v double"


def write(spark, rows, path, name):
    spark.createDataFrame(rows, "k string, s long, n long, v double").selectExpr("k", "timestamp_seconds(s) AS at", "n", "v").coalesce(1).write.parquet(f"{path}/{name}")


def run(df, checkpoint, out):
    """All that is there, appended to a folder."""
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("rule", ["sliding_window", "token_bucket"])
def test_decisions_over_restarts(spark, tmp_path, rule):
    rng = random.Random(1)
    limit = limits.Limit(3, 60, rule)
    rows = sorted((rng.choice("abcdefgh"), s, 0, 1.0) for s in rng.choices(range(2000), k=600))
    rows = [(k, s, i, v) for i, (k, s, _, v) in enumerate(sorted(rows, key=lambda r: r[1]))]
    rows += [("late idle", 10, 900, 1.0), ("a", 90_000, 901, 1.0)]
    rows.sort(key=lambda r: (r[1], r[2]))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for i, cut in enumerate((rows[:200], rows[200:350], rows[350:])):  # each part is a run of its own
        write(spark, cut, f"{tmp_path}/in", f"p{i}")
        stateful.decide(stream, "k", "at", "n", limit).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {r.call_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    calls = spark.createDataFrame([(k, s, n, v) for k, s, n, v in rows], "k string, s long, n long, v double").selectExpr("k", "timestamp_seconds(s) AS at", "n")
    assert got == {r.call_id: r.allowed for r in limits.decide(calls, "k", "at", "n", limit).collect()}
    # the last call is a day later: whoever was idle since has left
    name = "bucket" if rule == "token_bucket" else "accepted"
    assert {r.key.key for r in stateful.state_of(spark, f"{tmp_path}/c", name).select("key").collect()} == {"a"}


def test_running_statistics(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    parts = [[("a", 1, 1, 2.0), ("b", 2, 2, 5.0), ("a", 3, 3, None)], [("a", 4, 4, -4.0)]]
    for i, part in enumerate(parts):
        write(spark, part, f"{tmp_path}/in", f"p{i}")
        run(stateful.running_statistics(stream, "k", "v"), f"{tmp_path}/c", f"{tmp_path}/running{i}")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/running0").collect()} == {("a", 1, 2.0, 2.0, 2.0, 2.0), ("b", 1, 5.0, 5.0, 5.0, 5.0)}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/running1").collect()} == {("a", 2, -2.0, -1.0, -4.0, 2.0)}
    held = {(r.key.key, r.value.n, r.value.total) for r in stateful.state_of(spark, f"{tmp_path}/c", "statistics").collect()}
    assert held == {("a", 2, -2.0), ("b", 1, 5.0)}
