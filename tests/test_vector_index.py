"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from shutterlake import catalog
from shutterlake.operators import statistics, vector_index, vectors
from shutterlake.session import new_folder

DATA = "/root/testdata/sf0.01"


def hits_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


@pytest.mark.parametrize(("name", "k", "label"), [("vector_index_topk", 10, None), ("vector_index_filtered", 5, 1)])
def test_recall_against_exact_search(spark, rows, name, k, label):
    asked = rows.where("vec_id % 50 = 0")
    exact = hits_of(vectors.top_k(rows, asked, k, keep=None if label is None else F.col("label") == label))
    made = catalog.queries()[name](spark, DATA)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = hits_of(made)
    assert set(found) == set(exact) and all(len(v) == k for v in found.values())
    assert np.mean([len(set(found[q]) & set(exact[q])) / k for q in exact]) >= 0.9
    assert all(exact[q].get(i, s) == s for q, hits in found.items() for i, s in hits.items())


def test_every_row_is_in_one_list(spark, rows):
    path = new_folder(spark, "index")
    quantiser = vector_index.build(rows, path, sample=100)
    index = spark.read.parquet(path)
    assert sorted(r[0] for r in index.select("vec_id").collect()) == sorted(r[0] for r in rows.select("vec_id").collect())
    assert len(quantiser.centres) <= 100 and index.where("list is null").isEmpty()
    all_ = hits_of(vector_index.search(quantiser, path, rows, rows.where("vec_id < 5"), 10, probes=len(quantiser.centres), pool=10_000))
    assert all_ == hits_of(vectors.top_k(rows, rows.where("vec_id < 5"), 10))


def test_cells_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 100)
    monkeypatch.setattr(vector_index, "QUERIES", 10)
    r = np.random.default_rng(4)
    centre = r.normal(size=9) * 4
    made = [(i, (centre + r.normal(size=9) * 0.3 if i % 3 else r.normal(size=9)).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    path = new_folder(spark, "index")
    quantiser = vector_index.build(frame, path)
    asked = frame.where("vec_id % 20 = 0")
    found, exact = hits_of(vector_index.search(quantiser, path, frame, asked, 10)), hits_of(vectors.top_k(frame, asked, 10))
    assert set(found) == set(exact) and np.mean([len(set(found[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9


def test_another_score_ranks_again(spark, rows):
    path = new_folder(spark, "index")
    quantiser = vector_index.build(rows, path)
    psnr = lambda a, b: statistics.pair_metrics(a, b)["psnr"]
    got = vector_index.search(quantiser, path, rows, rows.where("vec_id = 100"), 3, score=psnr).orderBy("rank").collect()
    assert got[0]["vec_id"] == 100 and [r["rank"] for r in got] == [1, 2, 3] and got[1]["score"] >= got[2]["score"]


def test_nothing_to_index_and_widths(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector_index.build(none, new_folder(spark, "index")) is None
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(SparkRuntimeException, match="components"):
        vector_index.build(odd, new_folder(spark, "index"))
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    path = new_folder(spark, "index")
    quantiser = vector_index.build(few, path)
    assert hits_of(vector_index.search(quantiser, path, few, few.where("vec_id = 1"), 10)) == {1: {1: 1.0, 2: 0.0}}


def test_upserts_check_and_merge(spark):
    stored = spark.createDataFrame([("a", [1.0], {"x": "1"}), ("b", [2.0], None)], "id string, vector array<double>, payload map<string,string>")
    new = spark.createDataFrame([("b", [3.0], {"y": "2"}, 1), ("b", [4.0], {"id": "mine"}, 2), ("c", [5.0], None, None)], "id string, vector array<double>, payload map<string,string>, t int")
    got = {r["id"]: (r["vector"], r["payload"]) for r in vector_index.upsert_points(stored, new, width=1, order="t").collect()}
    assert got == {"a": ([1.0], {"x": "1"}), "b": ([4.0], {"id": "mine"}), "c": ([5.0], {"id": "c"})}
    with pytest.raises(SparkRuntimeException, match="2 components"):
        vector_index.upsert_points(stored, new.withColumn("vector", F.array(F.lit(1.0), F.lit(2.0))), width=1, order="t").collect()
