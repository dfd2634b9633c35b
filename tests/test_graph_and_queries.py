import pytest
from pyspark.sql import functions as F

from intelweave.operators import graph as G
from intelweave.operators import vectors as V
from intelweave.plans import api as A

ROW = ("title string, url string, primary_industry string, threat_score double, cve_ids array<string>, "
       "ip_addresses array<string>, malware_names array<string>, threat_actors array<string>, n int")


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([
        ("First report on things that are long enough", "u1", "Finance", 0.9, ["CVE-1"], ["1.1.1.1"], ["emotet", "ryuk"], ["apt1"], 1),
        ("Second", "u2", "", 0.8, ["CVE-1"], [], ["emotet"], [], 2),
        ("No entities", "u3", "ICS", 0.7, [], [], [], [], 3),
        ("No url", "", "ICS", 0.7, ["CVE-2"], [], [], [], 4),
    ], ROW)


def test_build(rows):
    nodes, edges = G.build_graph(rows, "n")
    assert nodes.groupBy("label").count().orderBy("label").collect() == [
        ("Article", 2), ("CVE", 1), ("IPAddress", 1), ("Industry", 1), ("Malware", 2), ("ThreatActor", 1)]
    kinds = {(r[0], r[1]): r[2] for r in edges.groupBy("src_label", "rel").count().collect()}
    assert kinds == {("Article", "MENTIONS"): 7, ("Article", "TARGETS"): 1, ("ThreatActor", "USES"): 2,
                     ("Malware", "EXPLOITS"): 2, ("ThreatActor", "TARGETS"): 1, ("ThreatActor", "USES_INFRASTRUCTURE"): 1}


def test_counters_count_attempts(rows):
    assert tuple(G.graph_counters(rows).first()) == (2, 7, 2 + 3 + 1 + 1)


def test_merge_twice_is_merge_once_and_old_targets_stay(rows):
    base = G.build_graph(rows, "n")
    new = G.build_graph(rows.where("url = 'u1'").withColumn("primary_industry", F.lit("ICS")), "n")
    once = G.merge_graph(*base, *new)
    twice = G.merge_graph(*once, *new)
    for a, b in zip(once, twice):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    targets = once[1].where("src = 'u1' and rel = 'TARGETS'").orderBy("dst")
    assert [r["dst"] for r in targets.collect()] == ["Finance", "ICS"]
    assert once[0].where("key = 'u1'").first()["industry"] == "ICS"
    assert {(r["industry"], r["count"]) for r in A.industry_stats(once[1]).collect()} == {("Finance", 1), ("ICS", 1)}
    assert A.top_entities(*once, industry="Finance").count() == 0


def test_last_row_sets_article_properties(rows):
    again = rows.unionByName(rows.where("n = 1").withColumns({"n": F.lit(9), "title": F.lit("Newer")}))
    assert G.article_nodes(again, "n").where("key = 'u1'").first()["title"] == "Newer"


def test_listing_and_names(spark, rows):
    nodes, edges = G.build_graph(rows, "n")
    listed = A.graph_listing(nodes, edges, "Finance").collect()
    assert len(listed) == 7 and {r["source_type"] for r in listed} == {"Article", "ThreatActor"}
    assert max(len(r["source"]) for r in listed) == 40
    assert A.graph_listing(nodes, edges, limit=3).count() == 3
    df = spark.createDataFrame([("", None, None, "t" * 50), ("", "", "", "")], "a string, b string, c string, d string")
    assert [r[0] for r in df.select(A.display_name(*map(F.col, "abcd"))).collect()] == ["t" * 40, "Unknown"]


def test_stats_and_top(spark, rows):
    nodes, edges = G.build_graph(rows, "n")
    vectors = spark.createDataFrame([("a", [0.1, 0.2])], "id string, embedding array<float>")
    assert A.stats(vectors, nodes, edges).first().asDict() == {
        "total_articles": 1, "industries_covered": 1, "embedding_dimensions": 2, "graph_nodes": 8, "graph_relationships": 14}
    top = A.top_entities(nodes, edges, limit=1).collect()
    assert [(r["kind"], r["name"], r["connections"]) for r in top] == [("CVE", "CVE-1", 2), ("Malware", "emotet", 2), ("ThreatActor", "apt1", 1)]


@pytest.fixture()
def vectors(spark):
    return spark.createDataFrame([
        ("a", [1.0, 0.0], "A", "ua", "0.5", "Finance", "d" * 400),
        ("b", [0.0, 1.0], "B", "ub", "x", "ICS", "short"),
        ("c", [-1.0, 0.0], "C", "uc", "0.9", "ICS", "short"),
    ], "id string, embedding array<float>, title string, url string, threat_score string, primary_industry string, document string")


def test_knn(vectors):
    hits = V.knn(vectors, [1.0, 0.0], 2).collect()
    assert [(h["id"], h["distance"], h["similarity"]) for h in hits] == [("a", 0.0, 1.0), ("b", 2.0, 0.0)]
    assert [h["id"] for h in V.knn(vectors, [1.0, 0.0], 5, "ICS").collect()] == ["b", "c"]
    assert V.knn(vectors, [1.0, 0.0], 3).collect()[2]["similarity"] == 0.0
    found = A.search_by_vector(vectors, [1.0, 0.0], top_k=1).first()
    assert len(found["snippet"]) == 300 and found["similarity_score"] == 1.0


def test_alerts(vectors):
    got = [(r["url"], r["threat_score"], r["count"]) for r in A.alerts(vectors).collect()]
    assert got == [("uc", 0.9, 3), ("ua", 0.5, 3), ("ub", 0.0, 3)]
    assert [r["url"] for r in A.alerts(vectors, industry="Finance").collect()] == ["ua"]


def test_add_vectors_once_per_id(vectors):
    new = vectors.unionByName(vectors)
    assert [r["id"] for r in V.add_vectors(new, vectors.where("id = 'a'")).orderBy("id").collect()] == ["b", "c"]


def test_text_search(spark):
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(
        ["emotet trojan bank", "hospital ransom note", "power grid malware"])], "url string, clean_text string")
    model = V.fit_embedder(df)
    meta = {c: F.lit("") for c in ("title", "threat_score", "primary_industry", "industry_score")}
    rows = V.vector_rows(V.embed(df, model).withColumns(meta))
    assert A.search(rows, "emotet bank", model, top_k=1).first()["url"] == "u0"
    with pytest.raises(ValueError):
        A.search(rows, "  ", model)


def test_user_encoder(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "clean_text string")
    out = V.embed_with(df, "clean_text", lambda: lambda ts: [[float(len(t))] for t in ts])
    assert sorted(r["embedding"][0] for r in out.collect()) == [1.0, 2.0]
