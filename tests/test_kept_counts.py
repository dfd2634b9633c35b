import random

from pyspark.sql import functions as F

from intelweave.operators import graph as G
from intelweave.operators import kept_counts as K
from intelweave.plans import api as A
from intelweave.sources import stores as S

ROW = ("title string, url string, primary_industry string, threat_score double, cve_ids array<string>, "
       "ip_addresses array<string>, malware_names array<string>, threat_actors array<string>, n int")


def increments(seed, count=4, size=14):
    """Articles of few URLs, so that later increments change industries and repeat edges."""
    draw = random.Random(seed)

    def some(prefix):
        return [f"{prefix}{draw.randrange(4)}" for _ in range(draw.randrange(3))]

    return [[("t", f"u{draw.randrange(12)}", draw.choice(["Finance", "ICS", "IoT", ""]), 0.9, sorted(set(some("CVE-"))), sorted(set(some("9.9.9."))),
              sorted(set(some("m"))), sorted(set(some("a"))), i) for i in range(size)] for _ in range(count)]


def rows(df):
    return sorted(map(tuple, df.select(*K.COUNT_COLUMNS, "n").collect()))


def write(spark, path, part, number):
    nodes, edges = G.build_graph(spark.createDataFrame(part, ROW), "n")
    S.write_graph(nodes, edges, f"{path}/graph", clear_first=number == S.BASE, increment=number)


def test_kept_counts_are_the_full_recount(spark, tmp_path):
    path = str(tmp_path)
    for number, part in enumerate(increments(1), S.BASE):
        write(spark, path, part, number)
        S.write_counts(spark, f"{path}/graph", f"{path}/counts", number)
        kept = S.read_counts(spark, f"{path}/counts")
        assert rows(kept) == rows(K.count_graph(*S.read_graph(spark, f"{path}/graph")))
    # Something was taken back, and repeating the last increment changes nothing.
    assert spark.read.parquet(f"{path}/counts").where("n < 0").count() > 0
    before = rows(kept)
    S.write_counts(spark, f"{path}/graph", f"{path}/counts", number)
    kept = S.read_counts(spark, f"{path}/counts")
    assert rows(kept) == before
    nodes, edges = S.read_graph(spark, f"{path}/graph")
    vectors = spark.range(3).select(F.array(F.lit(1.0)).alias("embedding"))
    for have, want in ((A.kept_stats(vectors, kept), A.stats(vectors, nodes, edges)),
                       (A.kept_top_entities(kept), A.top_entities(nodes, edges)),
                       (A.kept_top_entities(kept, "ICS", 3), A.top_entities(nodes, edges, "ICS", 3)),
                       (A.kept_industry_stats(kept), A.industry_stats(edges))):
        assert have.columns == want.columns and have.collect() == want.collect()


def test_a_graph_without_counts_is_counted_once_and_compaction_keeps_them(spark, tmp_path):
    path = str(tmp_path)
    parts = increments(3)
    for number in (S.BASE, 0):
        write(spark, path, parts[number + 1], number)
    S.compact_graph(spark, f"{path}/graph")
    write(spark, path, parts[2], 1)
    S.write_counts(spark, f"{path}/graph", f"{path}/counts", 1)
    S.compact_graph(spark, f"{path}/graph")
    assert rows(S.read_counts(spark, f"{path}/counts")) == rows(K.count_graph(*S.read_graph(spark, f"{path}/graph")))


def test_first_and_empty_increments(spark, tmp_path):
    path = str(tmp_path)
    write(spark, path, [], 0)
    S.write_counts(spark, f"{path}/graph", f"{path}/counts", 0)
    assert rows(S.read_counts(spark, f"{path}/counts")) == []
    write(spark, path, increments(4)[0], 1)
    S.write_counts(spark, f"{path}/graph", f"{path}/counts", 1)
    assert rows(S.read_counts(spark, f"{path}/counts")) == rows(K.count_graph(*S.read_graph(spark, f"{path}/graph")))
