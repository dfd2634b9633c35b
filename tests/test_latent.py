"""Latent vectors against the exact decomposition, and their odd rows."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intelweave.operators import latent as L
from intelweave.operators import vectors as V
from intelweave.plans import api as A


def dense(df, model):
    slots = len(model.weights)
    lists = pa.array([r[0] for r in df.select(L.word_slots(F.col(model.column), slots)).collect()], pa.list_(pa.int32()))
    out = np.zeros((len(lists), slots))
    for at, row, slot, value in L.sparse_rows(lists, model.weights):
        out[at.start + row, slot] = value
    return out


def test_error_is_near_the_exact_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    model = L.fit_latent(df, "text", dim=32, slots=2048)
    a = dense(df, model)
    left = lambda v: np.linalg.norm(a - a @ v @ v.T)
    exact = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.basis.T @ model.basis, np.eye(32), atol=1e-8)
    assert left(model.basis) <= 1.05 * left(exact[2][:32].T)
    assert (model.strength <= exact[1][:32] + 1e-9).all() and (np.diff(model.strength) <= 0).all()
    sharp = L.fit_latent(df, "text", dim=32, slots=2048, passes=4)
    assert left(sharp.basis) <= 1.005 * left(exact[2][:32].T)
    assert sharp.strength == pytest.approx(exact[1][:32], rel=0.03)


def test_chunks_and_partitions_agree(texts, monkeypatch):
    rng = np.random.default_rng(3)
    df = texts([" ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(1, 90))) for _ in range(80)])
    one = L.fit_latent(df.coalesce(1), dim=6, slots=256, passes=3)
    monkeypatch.setattr(L, "_CHUNK", 100)
    many = L.fit_latent(df.repartition(7), dim=6, slots=256, passes=3)
    assert np.allclose(one.basis, many.basis, atol=1e-6)
    vectors = np.array([r[0] for r in L.embed_latent(df.orderBy("doc_id"), many).select("embedding").collect()])
    want = dense(df.orderBy("doc_id"), one) @ one.basis
    assert np.allclose(vectors, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)


def test_odd_rows(spark, texts, tmp_path):
    df = texts(["bank trojan", None, "", "  ", "bank fraud", "bank trojan", "x " * 5000])
    model = L.fit_latent(df, dim=8, slots=512)
    assert model.basis.shape[1] <= 3
    rows = [np.array(r["embedding"]) for r in V.embed(df, model).orderBy("doc_id").collect()]
    assert [round(float(v @ v), 4) for v in rows] == [1, 0, 0, 0, 1, 1, 1] and (rows[0] == rows[5]).all()
    model.save(spark, str(tmp_path / "m"))
    again = L.load_latent(spark, str(tmp_path / "m"))
    assert (again.basis == model.basis).all() and (again.weights == model.weights).all() and again.column == model.column
    none = L.fit_latent(df.limit(0), dim=4, slots=64)
    assert V.embed(df.limit(0), none).count() == 0 and [len(r["embedding"]) for r in V.embed(df, none).collect()] == [0] * 7
    with pytest.raises(ValueError):
        L.fit_latent(df, dim=60, slots=64)


def test_search_meets_related_words(spark):
    rows = [(f"m{i}", f"emotet banking trojan stealer loader sample{i}") for i in range(20)] + [(f"g{i}", f"power grid outage substation relay site{i}") for i in range(20)]
    df = spark.createDataFrame([*rows, ("plain", "loader stealer")], "url string, clean_text string")
    model = L.fit_latent(df, dim=2, slots=4096)
    stored = V.vector_rows(V.embed(df, model).withColumns({c: F.lit("") for c in ("title", "threat_score", "primary_industry", "industry_score")}))
    found = [r["url"] for r in A.search(stored, "emotet", model, top_k=21).collect()]
    assert "plain" in found and not any(u.startswith("g") for u in found)
