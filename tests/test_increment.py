import json

import pytest
from pyspark.sql import functions as F

from intelweave.operators import tagging as C
from intelweave.operators import vectors as V
from intelweave.plans import batch as B
from intelweave.plans import increment as I
from intelweave.sources import stores as S
from intelweave.sources import tables as T
from intelweave.streaming import start_increments

THREAT = "emotet ransomware attack by apt28 from 45.33.32.156 using CVE-2024-1234 against bank network "
CALM = "garden flowers and summer recipes for a quiet family picnic near the river "


def raw_rows():
    rows = []
    for i in range(24):
        body = (THREAT if i % 2 == 0 else CALM) * 14 + f" number item{i}"
        rows.append((f"https://x.example/{i}", f"Report number {i} title", body if i % 6 else "too short"))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    rows = [(t * 3, y) for t, y in ((THREAT, 1), (CALM, 0)) for _ in range(8)]
    binary = C.train_binary(spark.createDataFrame(rows, "text string, label int"), features=512, iterations=10)
    names = spark.createDataFrame([("bank money " * 3, "Finance"), ("plant turbine " * 3, "ICS")] * 5, "text string, y string")
    coded = C.encode_labels(names, "y")
    texts = spark.createDataFrame([(THREAT,), (CALM,)], "clean_text string")
    return B.Models(binary, C.train_industry(coded, features=512, iterations=5), C.label_map(names, "y"), V.fit_embedder(texts))


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame(raw_rows(), "url string, title string, content string").withColumn("id", F.md5("url"))


def state(spark, layout):
    nodes, edges = S.read_graph(spark, layout.at("graph"))
    vectors = S.read_vectors(spark, layout.at("vectors")).select("id", "url", "primary_industry")
    ledger = S.read_increments(spark, layout.at("ledger"), I.LEDGER_SCHEMA).select("url")
    return [sorted(map(repr, df.collect())) for df in (nodes, edges, vectors, ledger)]


def test_halves_equal_whole_and_retries_change_nothing(spark, models, raw, tmp_path):
    whole, halves = B.Layout(str(tmp_path / "w")), B.Layout(str(tmp_path / "h"))
    first = I.run_increment(spark, raw, models, whole, 0).first()
    # 12 threats, of which those with i % 6 == 0 are too short.
    assert (first["new_articles"], first["threat_relevant"], first["vectors_total"]) == (24, 8, 8)
    I.run_increment(spark, raw.where("length(url) = 19"), models, halves, 0)
    I.run_increment(spark, raw, models, halves, 1)
    assert state(spark, whole) == state(spark, halves)
    I.run_increment(spark, raw, models, halves, 1)
    assert state(spark, whole) == state(spark, halves)
    again = I.run_increment(spark, raw, models, halves, 2).first()
    assert (again["new_articles"], again["embedded"], again["vectors_total"]) == (0, 0, 8)


def test_stream(spark, models, tmp_path):
    inbox, layout = tmp_path / "in", B.Layout(str(tmp_path / "s"))
    inbox.mkdir()
    rows = raw_rows()
    for part, name in ((rows[:12], "a"), (rows[8:], "b")):
        lines = [json.dumps({"url": u, "title": t, "content": c}) for u, t, c in part] + ["{broken"]
        (inbox / f"{name}.json").write_text("\n".join(lines))
    q = start_increments(spark, str(inbox), models, layout, str(tmp_path / "cp"), max_files=1)
    q.awaitTermination()
    nodes, edges, vectors, ledger = state(spark, layout)
    assert len(ledger) == 24 and len(vectors) == 8


def test_full_build(spark, models, raw, tmp_path):
    layout = B.Layout(str(tmp_path / "b"))
    B.build(spark, raw.drop("id"), models, layout)
    nodes, edges = S.read_graph(spark, layout.at("graph"))
    assert nodes.where("label = 'Article'").count() == 8
    assert S.read_vectors(spark, layout.at("vectors")).count() == 8
    # An increment after a build adds nothing twice.
    done = I.run_increment(spark, raw, models, layout, 0).first()
    assert (done["embedded"], done["vectors_total"]) == (0, 8)


def test_new_articles_first_per_url(spark):
    raw = spark.createDataFrame([("u", "b"), ("u", "a"), ("", "c"), ("v", "d")], "url string, title string")
    ledger = spark.createDataFrame([("v",)], "url string")
    assert [tuple(r) for r in I.new_articles(raw, ledger).collect()] == [("u", "a")]


def test_sources(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"title": "t", "url": "u", "cves": ["CVE-1"]}\nnot json\n{"url": "v", "title": 5}\n')
    good, bad = T.read_articles(spark, str(path))
    assert bad.first()["bad_count"] == 1
    assert {(r["url"], r["title"], r["content"]) for r in good.collect()} == {("u", "t", ""), ("v", "5", "")}
    ledger = str(tmp_path / "ledger")
    T.append_ledger(spark.createDataFrame([(" a ",), ("",)], "url string"), ledger)
    T.append_ledger(spark.createDataFrame([("b",)], "url string"), ledger)
    assert sorted(r["url"] for r in T.read_ledger(spark, ledger).collect()) == ["a", "b"]


def test_build_then_increment_keeps_all_entities(spark, models, raw, tmp_path):
    layout = B.Layout(str(tmp_path / "bi"))
    B.build(spark, raw.drop("id").where("length(url) = 19"), models, layout)
    ledger = S.read_increments(spark, layout.at("ledger"), I.LEDGER_SCHEMA)
    assert ledger.count() == 10
    done = I.run_increment(spark, raw, models, layout, 0).first()
    assert done["new_articles"] == 14
    rows = spark.read.parquet(layout.at("entities"))
    assert rows.select("url").distinct().count() == rows.count() == 8
    assert spark.read.parquet(f"{layout.at('fresh')}/increment=0").count() == 0
    before = [sorted(map(repr, df.collect())) for df in S.read_graph(spark, layout.at("graph"))]
    S.compact_graph(spark, layout.at("graph"))
    assert before == [sorted(map(repr, df.collect())) for df in S.read_graph(spark, layout.at("graph"))]
    assert spark.read.parquet(f"{layout.at('graph')}/nodes").select("increment").distinct().collect()[0][0] == S.BASE


def test_ledger_is_asked_before_rows_are_ordered(spark, tmp_path):
    spark.createDataFrame([("u", "t", "c")], "url string, title string, content string").write.parquet(str(tmp_path / "raw"))
    raw, ledger = spark.read.parquet(str(tmp_path / "raw")), spark.createDataFrame([("v",)], "url string")
    plan = I.new_articles(raw, ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<url:string>") == 1 and plan.count("ReadSchema: ") == 2
    assert plan.index("Window") < plan.index("LeftSemi") < plan.index("LeftAnti")


def test_tagger_and_names_in_the_build(spark, models, raw, tmp_path):
    stand_in = B.Models(None, None, None, models.embedder, tagger=lambda df: df.withColumns({
        "threat_score": F.lit(0.9), "primary_industry": F.lit("Finance"), "industry_score": F.lit(0.8)}),
        names=lambda df: df.withColumns({"model_malware": F.array(F.lit("newkit")), "model_actors": F.array(F.lit("microsoft"))}))
    layout = B.Layout(str(tmp_path / "t"))
    B.build(spark, raw.drop("id"), stand_in, layout)
    rows = spark.read.parquet(layout.at("entities")).collect()
    assert len(rows) == 20 and all("newkit" in r["malware_names"] and "microsoft" not in r["threat_actors"] for r in rows)


@pytest.mark.parametrize("stopped_at", range(6))
def test_a_compaction_that_died_is_repeated_without_loss(spark, tmp_path, monkeypatch, stopped_at):
    path = str(tmp_path / "g")
    nodes = lambda n, industry: spark.createDataFrame([("Article", f"u{n}", "t", industry, "0.5"), ("Article", "u", "t", industry, "0.5")], S.NODE_SCHEMA)
    edges = lambda n: spark.createDataFrame([("Article", f"u{n}", "TARGETS", "Industry", "x")], S.EDGE_SCHEMA)
    S.write_graph(nodes(0, "a"), edges(0), path)
    for n in (1, 2):
        S.write_graph(nodes(n, f"i{n}"), edges(n), path, clear_first=False, increment=n)
    rows = lambda: [sorted(map(repr, df.collect())) for df in S.read_graph(spark, path)]
    want, calls = rows(), [0]

    def failing(df, target, increment, write=S.write_increment):
        if calls[0] == stopped_at:
            # as an overwrite ends that has removed the old files and not yet written new ones
            write(df.limit(0), target, increment)
            raise OSError("lost")
        calls[0] += 1
        write(df, target, increment)

    monkeypatch.setattr(S, "write_increment", failing)
    with pytest.raises(OSError):
        S.compact_graph(spark, path)
    monkeypatch.undo()
    assert rows() == want
    S.write_graph(nodes(3, "i3"), edges(3), path, clear_first=False, increment=3)
    later = rows()
    assert len(later[0]) == len(want[0]) + 1 and len(later[1]) == len(want[1]) + 1
    S.compact_graph(spark, path)
    assert rows() == later
    S.compact_graph(spark, path)
    assert rows() == later
    assert {r[0] for r in spark.read.parquet(f"{path}/nodes").select("increment").distinct().collect()} == {S.BASE}


def test_entities_of_an_increment_are_those_of_a_build(spark, models, raw, tmp_path):
    stand_in = B.Models(None, None, None, models.embedder, tagger=lambda df: df.withColumns({
        "threat_score": F.lit(0.9), "primary_industry": F.lit("Finance"), "industry_score": F.lit(0.8)}),
        names=lambda df: df.withColumns({"model_malware": F.array(F.lit("newkit")), "model_actors": F.array(F.lit("microsoft"))}))
    built, grown = B.Layout(str(tmp_path / "b")), B.Layout(str(tmp_path / "g"))
    B.build(spark, raw.drop("id"), stand_in, built)
    I.run_increment(spark, raw, stand_in, grown, 0)
    keep = ["url", "cve_ids", "ip_addresses", "malware_names", "threat_actors"]
    a, b = (sorted(map(repr, spark.read.parquet(x.at("entities")).select(*keep).collect())) for x in (built, grown))
    assert a == b and len(a) == 20


def test_only_touched_buckets_of_the_ledger_are_read(spark, tmp_path):
    urls = lambda a, b: spark.range(a, b).select(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"))
    path = str(tmp_path / "ledger")
    assert S.read_ledger(spark, path, near=urls(0, 3)).count() == 0
    S.write_ledger(urls(0, 500), path, S.BASE)
    S.write_ledger(urls(500, 700), path, 0)
    S.write_ledger(urls(700, 800), path, 1)
    S.write_ledger(urls(700, 900), path, 1)  # a repeated run
    assert S.read_ledger(spark, path).count() == 900 and S.read_ledger(spark, path, before=1).count() == 700
    some = urls(498, 502)
    near = S.read_ledger(spark, path, near=some)
    assert near.join(some, "url", "left_semi").count() == 4 and near.count() < 200
    scan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("bucket=")[1].split("/")[0] for f in near.inputFiles()}
    held = {str(r[0]) for r in some.select(S.url_bucket(F.col("url"))).collect()}
    assert files >= held  # inputFiles lists before pruning; what is read is counted below
    read = near.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in read} == held
    new = I.new_articles(urls(895, 905).withColumn("title", F.lit("t")), S.read_ledger(spark, path, near=urls(895, 905)))
    assert sorted(r.url for r in new.collect()) == [f"https://x/{i}" for i in range(900, 905)]


def test_a_ledger_without_buckets_is_still_read(spark, tmp_path):
    path = str(tmp_path / "old")
    S.write_increment(spark.createDataFrame([("u",), ("v",)], "url string"), path, 0)
    near = S.read_ledger(spark, path, near=spark.createDataFrame([("u",), (None,)], "url string"))
    assert {r.url for r in near.collect()} == {"u", "v"}
