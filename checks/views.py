"""Input views derived from the sample tables, in Spark and as SQL text.

The sample texts carry no CVE ids, tags or advisory markup, so the views plant
some by row number. Both engines derive the same rows from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.operators import entities as E
from intelweave.plans import batch

_URL = "concat('https://', source, '.example.org/', lang, '/', cast(doc_id AS string))"
ARTICLE_SELECT = f"""
SELECT doc_id, md5({_URL}) AS id, {_URL} AS url,
       concat('Report ', source, ' number ', cast(doc_id AS string)) AS title,
       concat(text, CASE doc_id % 8
         WHEN 0 THEN concat(' Flaw CVE-2024-', lpad(cast(doc_id AS string), 5, '0'),
                            ' and cve-2023-4567 hit 45.33.32.156 and 10.0.0.8')
         WHEN 1 THEN ' the hive ransomware gang struck again'
         WHEN 2 THEN ' continuously watching bees in a hive on display'
         WHEN 3 THEN ' Lazarus Group used Emotet and Cobalt Strike with CVE-2021-44228'
         WHEN 4 THEN ' APT29 infrastructure 203.0.113.7 and TrickBot against Microsoft'
         WHEN 5 THEN ' Severity Rating: HIGH Software Affected: Example Server 1.0 to 2.0 Overview CIVN-2024-0042'
         WHEN 6 THEN ' <b>bold</b> WannaCry'
         ELSE '' END) AS content,
       CASE doc_id % 7 WHEN 0 THEN 'Healthcare' WHEN 1 THEN 'Finance' WHEN 2 THEN 'Government'
         WHEN 3 THEN 'IoT' WHEN 4 THEN 'ICS' WHEN 5 THEN 'Education'
         ELSE 'General Cybersecurity' END AS primary_industry,
       round(cast(doc_id % 100 AS double) / 100, 4) AS threat_score
FROM {{documents}}
"""

PAGE_SELECT = """
SELECT page_id,
       CASE page_id % 5
         WHEN 0 THEN concat('https://www.cert-in.org.in/s2cMainServlet?pageid=PUBVLNOTES01&VLCODE=CIVN-2024-',
                            lpad(cast(page_id AS string), 4, '0'))
         ELSE url END AS url,
       CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'TEXT/HTML' ELSE 'application/pdf' END
         AS content_type,
       concat(html, CASE page_id % 5
         WHEN 0 THEN concat('<h2>Advisory number ', cast(page_id AS string), ' &amp; note</h2><table><tr><td>',
           'Severity Rating: ', CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'CRITICAL' ELSE 'EXTREME' END,
           ' Software Affected: Example Server 1.0 to 2.', cast(page_id AS string), ' Overview</td><td>',
           'Note civn-2024-', lpad(cast(page_id AS string), 4, '0'), ' covers CVE-2024-1', lpad(cast(page_id AS string), 4, '0'),
           ' and cve-2021-44228</td></tr></table><a href="s2cMainServlet?pageid=PUBVLNOTES02&amp;VLCODE=CIVN-2024-9">n</a>',
           '<a class="x" href="/s2cMainServlet?pageid=PUBVLNOTES03">i</a><a href="/advisory/list">a</a>')
         WHEN 1 THEN '<!-- <meta property="og:title" content="not this one"> --><meta property="og:title" content="Shared &quot;story&quot; title"><p>Plain opening of the paragraph, before <b>a bold part nobody should read as direct text here</b> and its long enough closing part.<br>Second text node after the break of this paragraph</p><p>Deep markup follows right here in the text <b>a<i>b<u>c<em>d</em>e</u>f</i>g</b> and this tail with 5 < 6 stands behind all of it, isn&#8217;t it &#x201c;so&#x201d;</p>'
         WHEN 2 THEN concat('<a href="https://news.example.net/story/', cast(page_id % 20 AS string),
           '">s</a><a href="//cdn.example.org/lib">l</a><a href="more/x">m</a><a href="../up">u</a><a href="?q=1">q</a>',
           '<a href=''/single''>s</a><a class="a > b" href=/bare/x>b</a><a href = "../../../../four">f</a><a href="x?u=../../y/../z">z</a>',
           '<!-- <a href="/comment">c</a> --><script>"<a href=/script>"</script><a data-href="/no" title=" href=/no ">n</a><a href="a/./b/../c/..">d</a><A HREF="..">p</A>')
         WHEN 3 THEN '<a href="https://threatpost.com/item">t</a><a href="https://www.t.co/abc">c</a><a href="mailto:a@b.c">m</a><a href="#top">h</a><a href="/tag/x">g</a>'
         ELSE '<h4></h4><a>no target</a><base href="../base/"><a href="from-base">b</a><a href="&#47;rooted&#x2F;x">r</a>' END) AS html
FROM {pages}
"""

ARTICLES_SQL = ARTICLE_SELECT.format(documents="documents")
PAGES_SQL = PAGE_SELECT.format(pages="pages")


def read_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A sample table, which is one small file, dealt out over the task slots."""
    return spark.read.parquet(f"{sf}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism, key)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ARTICLE_SELECT, documents=documents(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(PAGE_SELECT, pages=read_table(spark, sf, "pages", "page_id"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return batch.cleaned(articles(spark, sf))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract_entities(cleaned(spark, sf))


def collection(spark: SparkSession, sf: str) -> DataFrame:
    """Every article's metadata with a vector of the ``embeddings`` table, taken in turn."""
    rows = articles(spark, sf).selectExpr(
        "doc_id", "id", "content AS document", "title", "url",
        "CASE WHEN doc_id % 10 = 9 THEN 'n/a' ELSE cast(threat_score AS string) END AS threat_score",
        "primary_industry", "'0.5' AS industry_score",
    )
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    turn = F.col("doc_id") % vectors.agg(F.count("*").alias("n")).scalar()
    return rows.withColumn("vec_id", turn).join(vectors, "vec_id").drop("vec_id")


# -- SQL building blocks -------------------------------------------------


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_cves(c: str) -> str:
    return (f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '{vocab.CVE_PATTERN}'), "
            "lambda v: upper(v))))")


def sql_private(c: str) -> str:
    return f"list_bool_or(list_transform({sql_list(vocab.PRIVATE_IP_PREFIXES)}, lambda p: starts_with({c}, p)))"


def sql_ips(c: str) -> str:
    prefix = "^(" + "|".join(p.replace(".", r"\.") for p in vocab.PRIVATE_IP_PREFIXES) + ")"
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({c}, '{vocab.IPV4_PATTERN}'), "
            f"lambda v: NOT regexp_matches(v, '{prefix}'))))")


def sql_tags(c: str) -> str:
    return f"regexp_replace({c}, '<.*?>', ' ', 'g')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '[^a-zA-Z0-9., \\-]', ' ', 'g')"


def sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    t = f"lower({c})"
    t = rf"regexp_replace({t}, ',([^0-9]|$)', ' , \1', 'g')"
    t = rf"regexp_replace({t}, '(\.\.+|--)', ' \1 ', 'g')"
    t = (rf"regexp_replace({t}, '\b(?:(can)not|(gim)me|(gon)na|(got)ta|(lem)me|(wan)na)\b', "
         r"'\1\2\3\4\5\6 ', 'g')")
    t = rf"regexp_replace({t}, '([^. ])\.( |$)', '\1\2', 'g')"
    return (f"array_to_string(list_filter(string_split({t}, ' '), lambda w: length(w) > 2 "
            f"AND NOT list_contains({sql_list(vocab.STOP_WORDS)}, w)), ' ')")


def sql_words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))"


def sql_join(c: str) -> str:
    return f"coalesce(array_to_string({c}, ', '), '')"


def with_articles(body: str) -> str:
    return f"WITH a AS ({ARTICLES_SQL})\n{body}"


def with_pages(body: str) -> str:
    return f"WITH RECURSIVE p AS ({PAGES_SQL})\n{body}"


CLEAN_CTES = f"""
a AS ({ARTICLES_SQL}),
bare AS (SELECT * EXCLUDE (content), content AS raw_content, {sql_tags("coalesce(content, '')")} AS t FROM a),
marked AS (SELECT *, {sql_cves("t")} AS c, {sql_ips("t")} AS i FROM bare),
joined AS (SELECT *, {sql_squash("concat_ws(' ', " + sql_strip("t") + ", array_to_string(c, ' '), array_to_string(i, ' '))")} AS body
           FROM marked),
clean AS (SELECT doc_id, id, url, title, primary_industry, threat_score, raw_content, {sql_tokens("body")} AS clean_text FROM joined)
"""

_TERMS = f"""
terms AS (SELECT 'malware' AS kind, unnest({sql_list(vocab.MALWARE_TERMS)}) AS term
          UNION ALL SELECT 'actor', unnest({sql_list(vocab.ACTOR_TERMS)})),
found AS (SELECT doc_id, kind, term, clean_text FROM clean, terms
          WHERE contains(lower(clean_text), term)
            AND regexp_matches(clean_text, '(?i)\\b' || regexp_escape(term) || '\\b'))
"""
# Ambiguous terms: token windows spelled out row by row.
_GUARD = f"""
toks AS (SELECT doc_id, term, string_split(lower(clean_text), ' ') AS tk FROM found
         WHERE kind = 'malware' AND list_contains({sql_list(list(vocab.AMBIGUOUS_CONTEXTS))}, term)),
spots AS (SELECT doc_id, term, tk, unnest(list_filter(generate_series(1, len(tk)), lambda i: tk[i] = term)) AS pos FROM toks),
near AS (SELECT doc_id, term, array_to_string(tk[greatest(pos - 10, 1):pos + 10], ' ') AS ctx FROM spots),
backed AS (SELECT DISTINCT doc_id, term FROM near
           WHERE regexp_matches(ctx, '\\b(' || array_to_string({sql_list(vocab.AMBIGUOUS_CONTEXTS['play'])}, '|') || ')\\b')),
kept AS (SELECT f.doc_id, f.kind, f.term FROM found f
         WHERE f.kind = 'actor' OR NOT list_contains({sql_list(list(vocab.AMBIGUOUS_CONTEXTS))}, f.term)
            OR EXISTS (SELECT 1 FROM backed b WHERE b.doc_id = f.doc_id AND b.term = f.term)),
listed AS (SELECT doc_id, coalesce(list(term ORDER BY term) FILTER (kind = 'malware'), []) AS m,
                  coalesce(list(term ORDER BY term) FILTER (kind = 'actor'), []) AS t FROM kept GROUP BY doc_id),
ent AS (SELECT clean.doc_id, title, url, primary_industry, threat_score, clean_text,
               {sql_cves("clean_text")} AS cve_ids, {sql_ips("clean_text")} AS ip_addresses,
               coalesce(m, []) AS malware_names, coalesce(t, []) AS threat_actors
        FROM clean LEFT JOIN listed ON clean.doc_id = listed.doc_id)
"""
ENTITY_CTES = CLEAN_CTES + "," + _TERMS + "," + _GUARD

GATED = "ga AS (SELECT * FROM ent WHERE url <> '' AND len(cve_ids) + len(ip_addresses) + len(malware_names) + len(threat_actors) > 0)"
_LONG = """
m AS (SELECT url, primary_industry, unnest(malware_names) AS v, cve_ids FROM ga),
t AS (SELECT url, primary_industry, unnest(threat_actors) AS v, malware_names, ip_addresses FROM ga),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'Article' AS src_label, url AS src, 'MENTIONS' AS rel, 'CVE' AS dst_label, unnest(cve_ids) AS dst FROM ga
    UNION ALL SELECT 'Article', url, 'MENTIONS', 'Malware', v FROM m
    UNION ALL SELECT 'Article', url, 'MENTIONS', 'ThreatActor', v FROM t
    UNION ALL SELECT 'Article', url, 'MENTIONS', 'IPAddress', unnest(ip_addresses) FROM ga
    UNION ALL SELECT 'Article', url, 'TARGETS', 'Industry', primary_industry FROM ga
    UNION ALL SELECT 'ThreatActor', v, 'USES', 'Malware', unnest(malware_names) FROM t
    UNION ALL SELECT 'Malware', v, 'EXPLOITS', 'CVE', unnest(cve_ids) FROM m
    UNION ALL SELECT 'ThreatActor', v, 'TARGETS', 'Industry', primary_industry FROM t
    UNION ALL SELECT 'ThreatActor', v, 'USES_INFRASTRUCTURE', 'IPAddress', unnest(ip_addresses) FROM t)
  WHERE dst <> ''),
nodes AS (
  SELECT 'Article' AS label, url AS key, title, primary_industry AS industry, cast(threat_score AS varchar) AS threat_score FROM ga
  UNION ALL
  SELECT DISTINCT dst_label, dst, NULL, NULL, NULL FROM edges)
"""
GRAPH_CTES = ENTITY_CTES + "," + GATED + "," + _LONG

COLLECTION_CTES = f"""
a AS ({ARTICLES_SQL}),
col AS (SELECT doc_id, id, content AS document, title, url,
               CASE WHEN doc_id % 10 = 9 THEN 'n/a' ELSE cast(threat_score AS varchar) END AS threat_score,
               primary_industry, '0.5' AS industry_score, embedding
        FROM a JOIN embeddings e ON e.vec_id = a.doc_id % (SELECT count(*) FROM embeddings))
"""
