import numpy as np
import pytest
from pyspark.sql import functions as F

from intelweave.operators import knn_join as K

SCHEMA = "id long, embedding array<float>, v string, cell int, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "v", 1, 1) for i, v in rows], SCHEMA)


def brute(queries, vectors, k):
    out = []
    for qid, q in queries:
        near = sorted((float(np.square(np.float32(v).astype(float) - np.float32(q).astype(float)).sum()), i) for i, v in vectors)[:k]
        out += [(qid, i, round(d, 9)) for d, i in near]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.id, round(r.distance, 9)) for r in df.collect())


def clustered(n, dim, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    return (centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("dim,spread,k", [(6, 0.02, 4), (32, 1.0, 3), (2, 0.3, 10)])
def test_neighbours_equal_brute_force(spark, dim, spread, k, monkeypatch):
    monkeypatch.setattr(K, "MEMBERS", 10)
    vectors = [(i, v.tolist()) for i, v in enumerate(clustered(400, dim, 1, spread))]
    queries = [(10_000 + i, v.tolist()) for i, v in enumerate(clustered(60, dim, 2, spread))] + vectors[:20]
    assert got(K.knn_join(table(spark, queries), table(spark, vectors), k, pivots=24)) == brute(queries, vectors, k)


def test_cells_are_pruned(spark):
    vectors = clustered(1500, 8, 3)
    df = table(spark, list(enumerate(vectors.tolist()))).select("id", F.col("embedding").alias("v"))
    pivots = K.choose_pivots(df, 8, 40, 42)
    cells = K.cells_of(K.assigned(df, pivots), pivots, 5)
    assert cells.size.sum() == 1500
    d = cells.distances(vectors.astype(float))
    needed = cells.needed(d, cells.radius(d, 5))
    exact = np.sort(np.linalg.norm(vectors[:, None].astype(float) - vectors[None].astype(float), axis=2), 1)[:, 4]
    assert (cells.radius(d, 5) >= exact - 1e-9).all()
    assert needed.any(1).all() and needed.mean() < 0.2  # over four of five cells are never looked at


def test_blocks_split_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "MEMBERS", 10)
    rng = np.random.default_rng(4)
    vectors = [(i, [1.0, 2.0] if i % 3 else rng.standard_normal(2).tolist()) for i in range(300)]
    df = table(spark, vectors)
    assert got(K.knn_join(df, df, 4, pivots=6)) == brute(vectors, vectors, 4)


def test_odd_rows(spark):
    rows = [(1, [0, 0]), (2, [0, 1]), (2, [0, 1]), (None, [0, 0]), (3, None), (4, []), (5, [1, None]), (6, [float("nan"), 0]), (7, [1, 2, 3]), (8, [float("inf"), 0])]
    df = table(spark, rows)
    near = [(str(r.query_id), str(r.id), r.distance, r.similarity) for r in K.knn_join(df, df, 3).collect()]
    assert sorted(near) == sorted([("1", "None", 0.0, 1.0), ("1", "1", 0.0, 1.0), ("1", "2", 1.0, 0.5), ("None", "None", 0.0, 1.0), ("None", "1", 0.0, 1.0),
                                   ("None", "2", 1.0, 0.5), ("2", "2", 0.0, 1.0), ("2", "2", 0.0, 1.0), ("2", "None", 1.0, 0.5)])
    assert K.knn_join(df.limit(0), df, 3).count() == 0 and K.knn_join(df, df.limit(0), 3).count() == 0
    assert K.knn_join(df, table(spark, [(1, [0, 0])]), 3).count() == 3


def test_text_ids(spark):
    df = spark.createDataFrame([("b", [0.0]), ("a", [0.0]), ("é", [0.0]), (None, [5.0])], "id string, embedding array<double>")
    near = K.knn_join(df.where("id = 'é'"), df, 3).orderBy("id").collect()
    assert [r.id for r in near] == ["a", "b", "é"]


def test_queries_are_sent_to_a_fixed_number_of_parts(spark, monkeypatch):
    """Where nothing can be pruned, four times the vectors in more blocks cost no query more copies."""
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "MEMBERS", 10)
    monkeypatch.setattr(K, "PARTS", 3)
    copies = []
    for n in (200, 800):
        df = table(spark, list(enumerate(clustered(n, 24, 7, 3.0).tolist()))).select("id", F.col("embedding").alias("v"))
        pivots = K.choose_pivots(df, 24, 12, 42)
        cells = K.cells_of(K.assigned(df, pivots), pivots, 3)
        sent = K.asked(df, cells, 3)
        copies.append(sent.selectExpr("sum(size(ids))").first()[0] / n)
        spots = [(r.cell, r.block, r.part) for r in spark.createDataFrame([(c, b) for c in range(len(cells.size)) for b in range(cells.blocks[c])], "cell int, block int")
                 .withColumn("part", cells.part(F.col("cell"), F.col("block"))).collect()]
        assert {(c, p) for c, _, p in spots if cells.size[c]} == set(zip(*map(list, np.nonzero(cells.parts()))))
        assert {p for _, _, p in spots} == {0, 1, 2}
    assert max(copies) <= 3


def test_equal_vectors_under_different_ids_are_asked_each(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 2)
    vectors = [(i, [1.0, 1.0]) for i in range(12)] + [(20, [2.0, 1.0])]
    df = table(spark, vectors)
    assert got(K.knn_join(df, df, 3)) == brute(vectors, vectors, 3)
