"""The vector index, learned vectors and the weighted reranker against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.functions import learned
from casebook.operators import link, vector_index
from casebook.plans import linking, vectors
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(vectors.QUERIES))
def test_query(spark, name):
    df = vectors.QUERIES[name](spark, SF)
    if name in vectors.ORACLE_SQL:
        assert difference(df, vectors.ORACLE_SQL[name], SF) == ""
    else:
        assert df.count() > 0


def entries(spark, seed=1, n=600, width=12, clusters=20):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((clusters, width))
    rows = [(int(k), int(k % 7), (centres[k % clusters] + 0.3 * draw.standard_normal(width)).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "entry_id long, code long, vector array<double>")


def found(df):
    return sorted((r["query_id"], r["entry_id"], r["code"], r["similarity"]) for r in df.collect())


def test_exact_search_is_the_full_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 12 * 8 * 10)  # a hot list is many blocks
    rows, df = entries(spark)
    hot = [(10_000 + k, 1, rows[0][2]) for k in range(300)]  # a third of all entries are one vector
    odd = [(20_000, 1, None), (20_001, 1, [0.0] * 12), (20_002, 2, [float("nan")] * 12), (20_003, 2, [1e-200] * 12), (20_004, 3, [1e200] * 12)]
    df = df.union(spark.createDataFrame(hot + odd, df.schema)).repartition(3)
    path = f"file://{tmp_path}/index"
    index = vector_index.build(df, path)
    again = vector_index.open_index(spark, path)
    assert again.probes == index.probes and index.sizes.sum() == len(rows) + len(hot) + 2
    asked = df.where("entry_id % 40 = 0 or entry_id > 20000").select(F.col("entry_id").alias("query_id"), "vector")
    usable = df.where("entry_id not in (20000, 20001, 20002)")
    # squares of the last two are beyond doubles in a plain product
    plain = asked.where("query_id < 20000")
    want = [r for r in found(link.retrieve(plain, usable.where("entry_id < 20000"), 15))]
    got = [r for r in found(vector_index.exact(again, plain, 15)) if r[1] < 20_000]
    assert got == want
    assert found(vector_index.search(again, plain, 15, probes=len(index.centroids))) == found(vector_index.exact(again, plain, 15))


def test_probed_lists_hold_the_true_neighbours(spark, tmp_path):
    _, df = entries(spark, 2, 2000)
    index = vector_index.build(df, f"file://{tmp_path}/index")
    asked = df.where("entry_id % 10 = 0").select(F.col("entry_id").alias("query_id"), "vector")
    true = link.retrieve(asked, df, 10)
    assert index.probes < len(index.centroids) / 2  # a part of the entries is enough
    assert vector_index.recall(vector_index.search(index, asked, 10), true).first()["recall"] >= 0.9


def test_odd_tables_for_the_index(spark, tmp_path):
    _, df = entries(spark, 3, 5)
    index = vector_index.build(df, f"file://{tmp_path}/few", lists=100)
    assert len(index.centroids) == 5
    asked = df.select(F.col("entry_id").alias("query_id"), "vector")
    assert vector_index.exact(index, asked, 50).count() == 25
    assert vector_index.search(index, asked.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        vector_index.build(df.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="another width"):
        vector_index.exact(index, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).collect()


def test_learned_vectors_are_the_main_directions(spark):
    names = [f"{a} {b}" for a in ("iron", "steel", "copper", "tin") for b in ("plate", "screw", "bolt", "wire", "tube")]
    made = learned.fit(spark.createDataFrame([(n,) for n in names * 3], "name string"), "name", width=20)
    whole = np.zeros((len(names), learned.PLACES))
    for k, n in enumerate(names):
        at, x = learned._row(n, made.weights)
        whole[k, at] = x
    # twenty names have rank twenty at most, so that products of vectors are those of the weighted counts
    got = np.array([made.vector(n) for n in names])
    assert np.allclose(got @ got.T, whole @ whole.T, atol=1e-6)
    assert made.vector("") is not None and made([None, "zz"]) is not None


def test_learned_vectors_link_more_than_hashed_ones(spark):
    share = {}
    for name, embedder in (("learned", None), ("hashed", linking.hashed_trigrams)):
        share[name] = vectors.linked(spark, SF, embedder).agg(F.avg((F.coalesce(F.col("code") == F.col("found"), F.lit(False))).cast("int"))).first()[0]
    assert share["learned"] >= share["hashed"] and share["learned"] > 0.8, share


def test_reranking_stays_in_expressions(spark):
    df = spark.createDataFrame([("a rare word", ["a rare thing", "b"]), ("a", []), (None, ["x"]), ("a rare word", ["a rare thing", "b"])], "t string, s array<string>")
    weights = spark.createDataFrame([("a", 0.1), ("rare", 2.0), ("b", 1.0)], "word string, weight double")
    out = link.rerank(df, "t", "s", weights)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(round(r["score"], 6) for r in out.collect())
    want = round((0.1 + 2.0) / (0.1 + 2.0 + 2.0 + 2.0 + 1.0), 6)  # words without a weight weigh the most of all
    assert got == sorted([want, want, 0.0, 0.0])
    assert "Python" not in link.rerank(df, "t", "s")._jdf.queryExecution().executedPlan().toString()
