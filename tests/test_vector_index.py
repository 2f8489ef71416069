"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import vector_index as V
from millrace.operators.retrieval import best_match, nearest


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 16))
    rows = [(i, (middle[i % 20] + 0.3 * rng.normal(size=16)).tolist(), i % 3) for i in range(1200)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [1.0, 2.0], 1), (5004, rows[7][1], 1), (5005, rows[7][1], 1)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").cache()


def queries(df):
    return df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qvec"))


def test_recall_and_probes(spark, grouped, tmp_path):
    index = V.write_index(grouped, "id", "v", f"file://{tmp_path}/index", 30, rows_per_file=50)
    again = V.open_index(spark, index.path)
    assert np.allclose(again.centres, index.centres) and 1 < len(again.centres) <= 30
    assert {r.item for r in again.rows().collect()} == {*range(1200), 5004, 5005}
    asked = queries(grouped)
    exact = {(r.query_id, r.id) for r in nearest(grouped, "id", "v", asked, 10).collect() if r.id != 5003}
    recalls = V.recall_by_probes(again, nearest(grouped, "id", "v", asked, 10).select("query_id", F.col("id").alias("item")), asked)
    assert recalls == sorted(recalls) and recalls[-1] == pytest.approx(1.0)
    for probes in (1, 3, len(again.centres)):
        hits = {(r.query_id, r["item"]) for r in V.search_index(again, asked, 10, probes).collect()}
        assert len(hits & exact) / len(exact) == pytest.approx(recalls[probes - 1])
    tuned = V.tuned_search(again, grouped, "id", "v", asked, 10).collect()
    assert np.mean([r.recall for r in {x.query_id: x for x in tuned}.values()]) >= 0.9
    assert tuned[0].probes == V.probes_for(recalls, 0.9) < len(again.centres)


def test_unasked_cells_are_pruned(spark, grouped, tmp_path):
    index = V.write_index(grouped, "id", "v", f"file://{tmp_path}/pruned", 30)
    one = queries(grouped).filter("query_id = 10")
    plan = V.search_index(index, one, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert V.search_index(index, one.filter("query_id < 0"), 5, 2).count() == 0


def test_empty_index(spark, grouped, tmp_path):
    index = V.write_index(grouped.limit(0), "id", "v", f"file://{tmp_path}/none", 5)
    assert V.search_index(index, queries(grouped), 5, 3).count() == 0


def test_best_match(grouped):
    rows = [r for r in grouped.collect() if r.v is not None]
    unit = {r.id: (r.label, np.array(r.v) / np.linalg.norm(r.v)) for r in rows if np.isfinite(r.v).all() and np.any(r.v)}
    asked = grouped.filter("id % 10 = 0 or id > 5000").select(F.col("id").alias("query_id"), F.col("v").alias("qvec"), "label")
    got = {r.query_id: (r.id, r.sim) for r in best_match(grouped, "id", "v", asked, 0.6, scope="label", earlier_only=True).collect()}
    want = {}
    for i in unit:
        if i % 10 == 0 or i > 5000:
            fits = [(round(float(x @ unit[i][1]), 5), j) for j, (label, x) in unit.items() if j < i and label == unit[i][0] and len(x) == len(unit[i][1])]
            fits = [f for f in fits if f[0] >= 0.6]
            if fits:
                want[i] = max(fits)[::-1]
    assert got == {i: (j, pytest.approx(s)) for i, (j, s) in want.items()} and got[5005][0] == 5004


def test_queries(spark):
    found = catalog.queries()["evl12_index_recall"](spark, "/root/testdata/sf0.001").collect()
    assert np.mean([r.recall for r in found]) >= 0.9


def test_cells_of_rows_go_on_in_slices(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 3 > 0, F.array(F.col("id") % 5 + 1.0, F.lit(2.0))).alias("v"))
    centres = np.array([[1.0, 0.0], [0.0, 1.0]])
    found = V.with_cells(rows, "v", centres, 2).collect()
    assert [(r.id, r.cells) for r in found] == [(i, None if i % 3 == 0 else [0, 1] if i % 5 + 1 >= 2 else [1, 0]) for i in range(3000)]
