import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsift.operators.vector_search import nearest_many
from voxsift.sources import vector_index as vi

KEYS = {"key": "vec_id", "vector": "embedding"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def index(spark, rows):
    from voxsift.staging import fresh_path

    return vi.publish_vector_index(rows, vi.fit_centres(rows, 40, **KEYS), fresh_path(spark, "vectors"), slice_rows=40, **KEYS)


def queries(rows):
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def found(frame):
    out = {}
    for r in frame.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["vec_id"], round(r["distance"], 9)))
    return out


def test_all_centres_give_the_exact_search(rows, index):
    assert found(index.search(queries(rows), 10, 40)) == found(nearest_many(rows, queries(rows), 10, **KEYS))


def test_recall_over_all_queries(rows, index):
    exact, near = found(nearest_many(rows, queries(rows), 10, **KEYS)), found(index.search(queries(rows), 10, 24))
    assert set(exact) == set(near) and all(len(v) == 10 for v in near.values())
    share = np.mean([len(set(exact[q]) & set(near[q])) / 10 for q in exact])
    assert share >= 0.9, share


def test_only_folders_of_probed_centres_are_read(spark, rows, index):
    one = queries(rows).where("query = 0")
    probed = one.select(F.explode(index.nearest_centres(F.col("vector"), 3)).alias("c")).collect()
    held = index.rows.where(F.col("centre").isin([r["c"] for r in probed]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [centre" in plan
    assert index.rows.select("centre", "slice").distinct().groupBy("centre").count().agg(F.max("count")).first()[0] > 1
    got = found(index.search(one, 5, 3))[0]
    matrix = {r["vec_id"]: r["embedding"] for r in held.collect()}
    asked = np.array(one.first()["vector"], float)
    want = sorted((round(1 - float(np.dot(v, asked) / np.linalg.norm(np.array(v, float)) / np.linalg.norm(asked)), 9), k) for k, v in matrix.items())[:5]
    assert [(k, d) for d, k in want] == got


def test_many_queries_on_one_centre_go_in_blocks(rows, index, monkeypatch):
    whole = found(index.search(queries(rows), 3, 5))
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 2)
    assert found(index.search(queries(rows), 3, 5)) == whole


def test_edge_rows(spark, folder):
    data = [("a", [1.0, 0.0], 7), ("b", [0.0, 1.0], 7), ("c", [1.0, 1.0], 7), ("d", None, 7), ("e", [0.0, 0.0], 7), ("f", [1.0], 7), ("a2", [2.0, 0.0], 7)]
    rows = spark.createDataFrame(data, "name string, v array<double>, centre int")
    centres = spark.createDataFrame([(5, [1.0, 0.0]), (3, [0.0, 1.0])], "centre int, vector array<double>")
    index = vi.publish_vector_index(rows, centres, folder, "name", "v")
    # the third vector is as near to both centres and goes to the smaller number
    assert {r["name"]: r["centre"] for r in index.rows.collect()} == {"a": 5, "a2": 5, "b": 3, "c": 3, "d": -1, "e": -1, "f": -1}
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query int, vector array<double>")
    again = vi.open_vector_index(spark, folder, "name", "v")
    got = [(r["query"], r["name"], r["rank"]) for r in again.search(asked, 2, 1).orderBy("rank").collect()]
    assert got == [(1, "a", 1), (1, "a2", 2)]
    assert again.search(asked.limit(0), 2, 1).count() == 0
    with pytest.raises(ValueError, match="centres"):
        vi.publish_vector_index(rows, centres.limit(0), folder, "name", "v")
