"""The sorted store against a plain dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import store

SCHEMA = "n int, key string, value string, deleted boolean"


def batch(rng, n):
    return [(k, f"k{rng.randint(0, 40):03d}", rng.choice(["x", "y", None]), rng.random() < 0.3) for k in range(n)]


def state(batches):
    out = {}
    for ops in batches:
        for _, key, value, deleted in ops:
            out.pop(key, None)
            if not deleted:
                out[key] = value
    return out


def test_scans_at_snapshots_before_and_after_compaction(spark, tmp_path):
    rng, path = random.Random(1), f"file://{tmp_path}/store"
    assert store.last_snapshot(spark, path) == 0 and store.scan(spark, path).collect() == []
    batches, snapshots = [], []
    for size in (60, 1, 0, 80, 30):
        batches.append(batch(rng, size))
        shuffled = rng.sample(batches[-1], size)
        snapshots.append(store.write_batch(spark, path, spark.createDataFrame(shuffled, SCHEMA), [F.asc("n")]))
    assert snapshots == [60, 61, 61, 141, 171]

    def check(k, low=None, high=None):
        got = {r["key"]: r["value"] for r in store.scan(spark, path, low, high, snapshots[k]).collect()}
        assert got == {x: v for x, v in state(batches[: k + 1]).items() if (low is None or x >= low) and (high is None or x < high)}

    for k in range(5):
        check(k)
        check(k, "k010", "k025")
    store.compact(spark, path, live=[snapshots[1]])
    assert store.runs(spark, path).count() == 1
    check(1)
    check(4)
    check(4, "k030", None)
    with pytest.raises(ValueError, match="snapshot 60"):
        store.scan(spark, path, snapshot=60)
    batches.append(batch(rng, 25))
    snapshots.append(store.write_batch(spark, path, spark.createDataFrame(batches[-1], SCHEMA), [F.asc("n")]))
    check(5)
    check(4)
    check(1)
    store.compact(spark, path)
    check(5)
    rows = store._versions_read(spark, path, None, None, None)
    assert rows.where("deleted").isEmpty() and rows.count() == len(state(batches))


def test_a_scan_reads_only_runs_that_can_matter(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for low in (0, 100, 200):
        store.write_batch(spark, path, spark.range(low, low + 50).select(F.format_string("%05d", "id").alias("key"), F.lit("v").alias("value"), F.lit(False).alias("deleted"), "id"), [F.asc("id")])
    names = {r["first_key"]: r["run"].rpartition("/")[2] for r in store.runs(spark, path).collect()}
    read = lambda df: {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    some = store.scan(spark, path, "00110", "00120")
    plan = some._jdf.queryExecution().toString()
    assert read(some) == {names["00100"]} and "InMemoryFileIndex(1 paths)" in plan
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,00110), LessThan(key,00120)]" in plan
    assert some.count() == 10
    assert read(store.scan(spark, path, snapshot=100)) == {names["00000"], names["00100"]}


def test_null_keys_and_lost_commits(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    ops = spark.createDataFrame([(1, None, "v", False)], SCHEMA)
    with pytest.raises(Exception, match="a key is null"):
        store.write_batch(spark, path, ops, [F.asc("n")])
    assert store.last_snapshot(spark, path) == 0
    store.write_batch(spark, path, spark.createDataFrame([(1, "a", "v", False)], SCHEMA), [F.asc("n")])
    (tmp_path / "store/manifest/00000002").mkdir()  # a writer that was lost before its commit
    assert store.last_snapshot(spark, path) == 1
    assert store.write_batch(spark, path, spark.createDataFrame([(1, "b", "w", False)], SCHEMA), [F.asc("n")]) == 2
    assert {tuple(r) for r in store.scan(spark, path).collect()} == {("a", "v"), ("b", "w")}
