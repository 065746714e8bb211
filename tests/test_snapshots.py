from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from movewatch.operators import graph


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, label string, place int")


def test_only_buckets_that_differ_are_opened(spark, tmp_path):
    rows = [(f"n{i}", f"label {i}", i) for i in range(500)] + [("null", None, None)]
    new = [r for r in rows if r[0] != "n7"] + [("n500", "more", 1)]
    new = [(i, "other" if i == "n42" else label, p) for i, label, p in new]
    old, now = str(tmp_path / "old"), str(tmp_path / "new")
    graph.store_snapshot(nodes(spark, rows), old, 64)
    graph.store_snapshot(nodes(spark, new).repartition(7), now, 64)
    diff = graph.snapshot_diff(spark, old, now, nodes(spark, []).schema)
    assert rows_of(diff, "node_id", "change") == [("n42", "changed"), ("n500", "added"), ("n7", "removed")]
    touched = {r[0] for r in nodes(spark, [(i, "", 0) for i in ("n42", "n500", "n7")]).select(F.pmod(F.xxhash64("node_id"), F.lit(64))).collect()}
    plan = plan_of(diff)
    assert "PartitionFilters: [bucket" in plan
    listed = plan.split("PartitionFilters: [bucket")[1].split("]")[0]
    assert {int(b) for b in listed.split("(")[-1].split(")")[0].replace("bucket", "").split(",") if b.strip().isdigit()} <= touched or len(touched) == 1
    same = graph.snapshot_diff(spark, old, old, nodes(spark, []).schema)
    assert same.count() == 0


def test_empty_snapshots(spark, tmp_path):
    old, now = str(tmp_path / "old"), str(tmp_path / "new")
    graph.store_snapshot(nodes(spark, []), old, 8)
    graph.store_snapshot(nodes(spark, [("a", "x", 1), ("b", None, None)]), now, 8)
    schema = nodes(spark, []).schema
    assert rows_of(graph.snapshot_diff(spark, old, now, schema), "node_id", "change") == [("a", "added"), ("b", "added")]
    assert rows_of(graph.snapshot_diff(spark, now, old, schema), "node_id", "change") == [("a", "removed"), ("b", "removed")]
    assert graph.snapshot_diff(spark, old, old, schema).count() == 0
