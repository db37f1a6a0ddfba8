"""Snapshots by id, folder inventories with rows for what can't be read, and roots in roots."""

import os

from govlens import sinks
from govlens.operators.graph import outermost
from govlens.operators.ledger import merged_layers
from govlens.sources.folders import discovery_diagnostics, folder_inventory


def test_a_snapshot_replaces_only_its_own(spark, tmp_path):
    at = f"{tmp_path}/reports"
    first = spark.createDataFrame([("r1", 1), ("r2", 2)], "rule string, n int")
    sinks.write_snapshot(first, at, "007")
    sinks.write_snapshot(first.where("n = 1"), at, "b/8")
    sinks.write_snapshot(spark.createDataFrame([("r9", 9)], "rule string, n int"), at, "007")
    assert [tuple(r) for r in sinks.read_snapshot(spark, at, "007").collect()] == [("r9", 9)]
    assert [tuple(r) for r in sinks.read_snapshot(spark, at, "b/8").collect()] == [("r1", 1)]
    assert sinks.read_snapshot(spark, at, "none").count() == 0
    plan = sinks.read_snapshot(spark, at, "007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_id" in plan


def test_unreadable_entries_are_rows(spark, tmp_path):
    for name in ("src/a/x.cs", "src/a/deep/y.cs", "node_modules/z.js", "top.txt", "src/b/gen.designer.cs"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        open(f"{tmp_path}/{name}", "w").write("abc")
    os.symlink("loop", f"{tmp_path}/src/loop")
    for partitions in (1, 3, 64):
        rows = folder_inventory(spark, str(tmp_path), partitions).collect()
        found = {os.path.relpath(r.path, tmp_path): (r.length, r.error) for r in rows if r.path}
        assert found == {"src/a/x.cs": (3, None), "src/a/deep/y.cs": (3, None), "node_modules/z.js": (3, None), "top.txt": (3, None), "src/b/gen.designer.cs": (3, None), "src/loop": (None, "OSError")}
        assert len(rows) == 6
    gone = folder_inventory(spark, f"{tmp_path}/missing").collect()
    assert [(r.path, r.folder, r.error) for r in gone] == [(None, f"{tmp_path}/missing", "FileNotFoundError")]
    told = {(r.kind, r.reason): (r.n, r.affects_coverage) for r in discovery_diagnostics(folder_inventory(spark, str(tmp_path))).collect()}
    assert told == {("analysed", None): (3, False), ("excluded", "BuildOrDependencyCache"): (1, False), ("excluded", "GeneratedFile"): (1, False), ("unreadable file", "OSError"): (1, True)}


def test_roots_in_roots(spark):
    roots = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d/e",), ("c/d",), ("c/dd",), ("x/y/z/w",)], "module_path string")
    assert {r.module_path for r in outermost(roots).collect()} == {"a", "ab", "c/d", "c/dd", "x/y/z/w"}


def test_layers_merge_without_their_copies(spark):
    rows = spark.createDataFrame([("L", ["b", "a", "b"], 0.5), ("L", ["a"], 0.25), ("M", [], 1.0)], "layer string, files array<string>, confidence double")
    assert {r.layer: (r.files, r.confidence) for r in merged_layers(rows).collect()} == {"L": (["a", "b"], 0.25), "M": ([], 1.0)}
