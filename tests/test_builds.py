"""Serving builds, their gates, and publishing by version."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import serving as B
from millrace.sources import versions as V

ROWS = [("a", None, "A", None, 0), ("b", "a", "B", None, 0), ("c", "b", "same", "x", 0), ("d", "b", "same", "y", 1), ("e", "a", "E", None, 1), ("f", "e", "F", None, 0), ("g", None, "G", "z", 1), ("h", "f", "H", None, 0)]


def build(spark):
    nodes = spark.createDataFrame(ROWS, "id string, parent_id string, title string, content string, s int")
    return B.serving_build(nodes, ["s"], F.col("content").isNotNull())


def test_build(spark):
    got = {r.path: (r.depth, r.is_leaf, r.kept_leaves, r.pruned_leaves) for r in build(spark).collect()}
    assert got == {"A": (0, False, 2, 1), "A/B": (1, False, 2, 0), "A/B/same": (2, True, 1, 0), "A/B/same (2)": (2, True, 1, 0), "G": (0, True, 1, 0)}
    assert B.build_faults(build(spark)).count() == 0


def test_gates_refuse_a_broken_tree(spark, tmp_path):
    good = build(spark).cache()
    root = f"file://{tmp_path}/build"
    gates = lambda w: B.build_faults(w["nodes"])
    first = V.publish(spark, root, {"nodes": good}, {"nodes": ["id"]}, gates)
    broken = {
        "orphan": good.filter("path <> 'A/B'"),
        "empty_section": good.withColumn("kept_leaves", F.when(F.col("path") == "G", 0).otherwise(F.col("kept_leaves"))),
        "not_counted": good.withColumn("kept_leaves", F.when(F.col("path") == "A", 7).otherwise(F.col("kept_leaves"))),
        "wrong_depth": good.withColumn("depth", F.when(F.col("path") == "A/B", 5).otherwise(F.col("depth"))),
    }
    for gate, df in broken.items():
        assert gate in {r.gate for r in B.build_faults(df).collect()}
        with pytest.raises(V.RefusedVersion, match=gate):
            V.publish(spark, root, {"nodes": df}, {"nodes": ["id"]}, gates)
        assert V.current_version(spark, root) == first and V.read_current(spark, root, "nodes").count() == 5
    with pytest.raises(V.RefusedVersion, match="twice"):
        V.publish(spark, root, {"nodes": good.unionByName(good)}, {"nodes": ["id"]})
    with pytest.raises(V.RefusedVersion, match="without a key"):
        V.publish(spark, root, {"nodes": good.withColumn("id", F.lit(None).cast("string"))}, {"nodes": ["id"]})
    assert len([p for p in (tmp_path / "build").iterdir() if p.name.startswith("v-")]) == 1


def test_readers_keep_their_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, root, "t")
    made = []
    for n in (3, 5, 7):
        made.append(V.publish(spark, root, {"t": spark.range(n)}, {"t": ["id"]}))
        if n == 3:
            early = V.read_current(spark, root, "t")
    assert early.count() == 3 and V.read_current(spark, root, "t").count() == 7 and V.current_version(spark, root) == made[-1]
    assert V.drop_old_versions(spark, root, keep=1) == 2 and V.read_current(spark, root, "t").count() == 7
