"""The registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave.llm import decontam, fill_middle, licenses, main_text, packing, passages, quality_gam, repetition, secret_scan, simhash_dedup, token_store, url_filter, whitening
from intelweave.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def _(spark, sf):
    pieces = packing.pack(read(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_length", "padding")


@query("op10_token_store")
def _(spark, sf):
    folder = scratch(spark, "tokens")
    token_store.write_store(read(spark, sf, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    return token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_licenses")
def _(spark, sf):
    return licenses.scan_licenses(read(spark, sf, "documents"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_RULE_CASE = " ".join(f"WHEN {_FITS.format(h=r.partition('/')[0], p='/' + r.partition('/')[2])} THEN {{{i}}}"
                      for i, (_, r) in sorted(enumerate(url_filter.RULES), key=lambda x: (-len(x[1][1]), x[1][1])))
_PAIRS = ", ".join(f"'{s}'" for s in url_filter.TWO_PART_SUFFIXES)
_SPREAD = ("SELECT 1 / least(greatest(coalesce((sum((bad - n * prior) * (bad - n * prior)) - sum(n * prior * (1 - prior))) "
           "/ nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0), 0.001), 0.5) - 1 AS s FROM {}")
OP3_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce({_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
h0 AS (SELECT host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM p JOIN labels ON page_id = doc_id WHERE host <> '' AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS w FROM h0),
h2 AS (SELECT *, array_to_string(w[-2:], '.') AS pair FROM h1),
h AS (SELECT host, n, bad, CASE WHEN pair IN ({_PAIRS}) THEN array_to_string(w[-3:], '.') ELSE pair END AS domain,
  CASE WHEN pair IN ({_PAIRS}) THEN pair ELSE w[-1] END AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
x1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM x) AS prior FROM x),
x2 AS (SELECT suffix, (bad + prior * s) / (n + s) AS rate FROM x1, ({_SPREAD.format('x1')})),
d1 AS (SELECT d.*, rate AS prior FROM d JOIN x2 USING (suffix)),
d2 AS (SELECT domain, (bad + prior * s) / (n + s) AS rate FROM d1, ({_SPREAD.format('d1')})),
g1 AS (SELECT h.*, rate AS prior FROM h JOIN d2 USING (domain)),
g2 AS (SELECT host, n, s, (bad + prior * s) / (n + s) AS rate FROM g1, ({_SPREAD.format('g1')})),
bad AS (SELECT host, rate - sqrt(rate * (1 - rate) / (n + s + 1)) * 1.645 > 0.5 AS blocked FROM g2)
SELECT page_id, p.host, path, CASE {_RULE_CASE.format(*(f"'{r}'" for _, r in url_filter.RULES))} END AS rule,
  CASE {_RULE_CASE.format(*(f"'{a}'" for a, _ in url_filter.RULES))} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN bad ON p.host = bad.host""".replace("((host", "((p.host").replace("ends_with(host", "ends_with(p.host")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad where the label of its number says low quality or toxic."""
    known = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL")
    return known.select(F.col("doc_id").alias("page_id"), F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END").alias("bad"))


@query("op3_url_filter", OP3_SQL)
def _(spark, sf):
    return url_filter.judge_urls(read(spark, sf, "pages"), page_outcomes(read(spark, sf, "labels")))


@query("op4_quality_gam")
def _(spark, sf):
    docs = read(spark, sf, "documents")
    return quality_gam.score_quality(docs, quality_gam.train(docs, read(spark, sf, "labels")))


@query("op7_secrets")
def _(spark, sf):
    found = secret_scan.scan_secrets(read(spark, sf, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.concat_ws(",", spans))


@query("op8_repetition")
def _(spark, sf):
    return repetition.judge_repetition(read(spark, sf, "documents"))


@query("op9_simhash_dedup")
def _(spark, sf):
    found = simhash_dedup.near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_decontamination")
def _(spark, sf):
    return decontam.find_contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op6_passages")
def _(spark, sf):
    return passages.repeated_passages(read(spark, sf, "documents"))


@query("op11_whitening")
def _(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings"))


@query("op13_main_text")
def _(spark, sf):
    pages = read(spark, sf, "pages")
    found = main_text.extract(pages, main_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, text, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS y,
  coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", OP12_SQL)
def _(spark, sf):
    made = fill_middle.transform_texts(read(spark, sf, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
