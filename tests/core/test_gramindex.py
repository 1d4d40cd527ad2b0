"""Searches over the index find what a scan finds, over segments, and read only what they need."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entigraph.operators import gramindex, search
from entigraph.operators.gramindex import GramIndex


def test_codes():
    rng = np.random.default_rng(0)
    for numbers in ([], [0], [0, 1, 127, 128, 1 << 40], np.unique(rng.integers(0, 1 << 50, 500)), np.arange(1000)):
        numbers = np.array(numbers, np.int64)
        assert gramindex.decoded(gramindex.coded(numbers)).tolist() == numbers.tolist()
    assert len(gramindex.coded(np.arange(1000))) == 1000


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    some = lambda: "".join(rng.choices("abcABC é", k=rng.randint(0, 12)))
    rows = [(f"e{i}", some(), "x") for i in range(900)] + [("long", "needle in Häystack", "x"), ("n", None, "x")]
    index = GramIndex(spark, str(tmp_path_factory.mktemp("gram") / "index"), buckets=16)
    frame = lambda r: spark.createDataFrame(r, "id string, entity_text string, kind string").repartition(3)
    index.add(frame(rows))
    changed = [(f"e{i}", some(), "y") for i in range(0, 100, 7)] + [("new", "another NEEDLE", "y"), ("e1", None, "y")]
    index.add(frame(changed))
    stands = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    return index, frame([r for r in stands.values() if r[1] is not None])


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@pytest.mark.parametrize("part", ["NEEDLE", "aaaa", "ab", "bcé", "zzzz"])
def test_containing(index, part):
    found, rows = index
    assert same(found.containing(part), search.exact(rows, part))


@pytest.mark.parametrize(("text", "above"), [("needle in haystack", 0.8), ("needle in haystack", 0.5), ("aaaaaaaa", 0.75), ("", 0.5), ("anothr needle", 0.9)])
def test_fuzzy(index, text, above):
    found, rows = index
    assert same(found.fuzzy(text, above), search.fuzzy(rows, text, above))


def test_compact(index, tmp_path):
    found, rows = index
    new = found.compact(str(tmp_path / "new"))
    assert same(new.rows(), rows) and same(new.containing("needle"), search.exact(rows, "needle"))


def test_only_touched_folders_are_read(index):
    found, _ = index
    lists = found._lists("000000", gramindex.grams_of("needle"))
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in lists.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert 0 < len(read) <= 4
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket#" in plan.split("PartitionFilters")[1][:60]
