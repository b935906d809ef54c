import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import nearest, retrieval


def brute_force(queries, vectors, n, allowed=lambda q, v: True):
    out = []
    unit = lambda v: np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum())
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for q in queries:
        found = [(round(1 - float(unit(v[1]) @ unit(q[1])), 12), v[0]) for v in vectors if good(v[1]) and good(q[1]) and len(v[1]) == len(q[1]) and allowed(q, v)]
        out += [(q[0], i, d, k + 1) for k, (d, i) in enumerate(sorted(found)[:n])]
    return sorted(out)


@pytest.mark.parametrize(("vector_block", "query_block"), [(1 << 22, 1 << 20), (40, 16)])
def test_nearest_with_ties_lengths_and_odd_vectors(spark, monkeypatch, vector_block, query_block):
    monkeypatch.setattr(nearest, "VECTOR_BLOCK", vector_block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(3)
    own = [[float(x) for x in rng.integers(-3, 4, 8)] for _ in range(60)]
    vectors = [(f"v{i:03d}", own[i % 60], i % 3) for i in range(150)]  # most come two or three times
    vectors += [("n1", None, 0), ("n2", [], 0), ("n3", [0.0] * 8, 0), ("n4", [1.0, None] * 4, 1), ("n5", [float("nan")] * 8, 1), ("s1", [1.0, 2.0], 1), ("s2", [2.0, 1.0], None)]
    queries = [(i, own[i * 7], i % 3) for i in range(8)] + [(90, [1.0, 1.0], 1), (91, None, 0), (92, [0.0] * 8, 0)]
    v = spark.createDataFrame(vectors, "id string, vector array<double>, version int").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, vector array<double>, wanted int")
    show = lambda df: sorted((r.query_id, r.id, round(r.distance, 12), r["rank"]) for r in df.collect())
    assert show(retrieval.dense_search(q, v, 5)) == brute_force(queries, vectors, 5)
    same = F.col("version") == F.col("wanted")
    assert show(retrieval.dense_search(q, v, 5, same)) == brute_force(queries, vectors, 5, lambda a, b: a[2] == b[2])
    assert retrieval.dense_search(q, v.limit(0), 5).collect() == [] and retrieval.dense_search(q.limit(0), v, 5, same).collect() == []


def test_the_plan_joins_no_pairs(spark):
    v = spark.createDataFrame([("a", [1.0], 1)], "id string, vector array<double>, version int")
    plan = retrieval.dense_search(v.select(F.col("id").alias("query_id"), "vector"), v, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_products_of_blocks_are_bounded(spark, monkeypatch):
    """However many the queries, a product of blocks is no larger than PRODUCT; what is found does not depend on it."""
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)], "id int, vector array<double>").coalesce(1)
    q = v.select(F.col("id").alias("query_id"), "vector")
    show = lambda: sorted((r.query_id, r.id, round(r.distance, 12)) for r in nearest.best_pairs(q, v, 3, "id").collect())
    want = show()
    monkeypatch.setattr(nearest, "PRODUCT", 200)
    assert show() == want and len(want) == 270
