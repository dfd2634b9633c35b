"""Every registered query: a name, the Spark job and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as D
from intelweave import vocab
from intelweave.functions import entities as FE
from intelweave.functions import text as X
from intelweave.functions import urls as U
from intelweave.functions.vectors import similarity, squared_distance
from intelweave.operators import bio as B
from intelweave.operators import boundaries as S
from intelweave.operators import entities as E
from intelweave.operators import graph as G
from intelweave.operators import knn_join as K
from intelweave.operators import latent as L
from intelweave.operators import quality as Q
from intelweave.operators import sampling as R
from intelweave.operators import tagger as N
from intelweave.operators import tagging as C
from intelweave.operators import vectors as V
from intelweave.operators import web as P
from intelweave.plans import api as A
from intelweave.plans import increment as I
from intelweave.sources import stores, tables
from intelweave.plans.batch import stage
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


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# == Text functions =========================================================


@query("strip_tags", D.with_articles(f"SELECT doc_id, {D.sql_tags('content')} AS txt FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.strip_tags("content").alias("txt"))


@query("extract_cves", D.with_articles(f"SELECT doc_id, {D.sql_join(D.sql_cves('content'))} AS cves FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.join_list(X.extract_cves("content")).alias("cves"))


@query("extract_ips", D.with_articles(f"SELECT doc_id, {D.sql_join(D.sql_ips('content'))} AS ips FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.join_list(X.extract_ips("content")).alias("ips"))


# Addresses in and around the private ranges, spelled from the row number.
_ADDRESS = ("concat(CASE doc_id % 6 WHEN 0 THEN '10.' WHEN 1 THEN '172.' WHEN 2 THEN '192.168.' WHEN 3 THEN '010.' "
            "WHEN 4 THEN '8.' ELSE '169.254.' END, cast(doc_id % 40 AS string), '.', cast(doc_id % 200 AS string), '.7')")


@query("is_private_ip",
       f"SELECT doc_id, {_ADDRESS} AS ip, {D.sql_private('(' + _ADDRESS + ')')} AS is_private FROM documents")
def _(spark, sf):
    rows = D.documents(spark, sf).selectExpr("doc_id", f"{_ADDRESS} AS ip")
    return rows.withColumn("is_private", X.is_private_ip("ip"))


@query("strip_chars", D.with_articles(f"SELECT doc_id, {D.sql_strip('content')} AS txt FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.strip_chars("content").alias("txt"))


@query("reinject_indicators", D.with_articles(
    f"SELECT doc_id, concat_ws(' ', title, nullif(array_to_string(list_concat({D.sql_cves('content')}, "
    f"{D.sql_ips('content')}), ' '), '')) AS txt FROM a"))
def _(spark, sf):
    saved = X.reinject("title", X.extract_cves("content"), X.extract_ips("content"))
    return D.articles(spark, sf).select("doc_id", saved.alias("txt"))


@query("squash_whitespace", f"SELECT doc_id, {D.sql_squash('text')} AS txt FROM documents")
def _(spark, sf):
    return D.documents(spark, sf).select("doc_id", X.squash_ws("text").alias("txt"))


@query("tokenize_clean", D.with_articles(f"SELECT doc_id, {D.sql_tokens(D.sql_strip('content'))} AS txt FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.tokenize_clean(X.strip_chars("content")).alias("txt"))


@query("clean_text", f"WITH {D.CLEAN_CTES} SELECT doc_id, clean_text FROM clean")
def _(spark, sf):
    return D.cleaned(spark, sf).select("doc_id", "clean_text")


@query("word_count", f"SELECT doc_id, {D.sql_words('text')} AS words FROM documents")
def _(spark, sf):
    return D.documents(spark, sf).select("doc_id", long(X.word_count("text")).alias("words"))


@query("url_ids", D.with_articles("SELECT doc_id, md5(url) AS url_id FROM a"))
def _(spark, sf):
    return D.articles(spark, sf).select("doc_id", X.url_id("url").alias("url_id"))


@query("list_codec", D.with_articles(
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(concat(title, ' , nan,, ', "
    "primary_industry, ',NaN , ', id), ','), lambda s: trim(s)), lambda s: s <> '' AND lower(s) <> 'nan'), ', ') "
    "AS items FROM a"))
def _(spark, sf):
    raw = D.articles(spark, sf).selectExpr(
        "doc_id", "concat(title, ' , nan,, ', primary_industry, ',NaN , ', id) AS raw")
    return raw.select("doc_id", X.join_list(X.parse_list("raw")).alias("items"))


# == Quality ================================================================

_MIN = "WITH " + D.CLEAN_CTES + " SELECT doc_id FROM clean WHERE " + D.sql_words("clean_text")


@query("min_words_batch", _MIN + " > 100")
def _(spark, sf):
    return Q.min_words(D.cleaned(spark, sf)).select("doc_id")


@query("min_words_incremental", _MIN + " >= 100")
def _(spark, sf):
    return Q.min_words(D.cleaned(spark, sf), inclusive=True).select("doc_id")


@query("min_words_training", _MIN + " > 30")
def _(spark, sf):
    return Q.min_words(D.cleaned(spark, sf), vocab.TRAINING_MIN_WORDS).select("doc_id")


@query("dedupe_text", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    return Q.dedupe_text(D.documents(spark, sf), "doc_id", "text").select("doc_id")


_TITLE = ("CASE doc_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '   short   ' WHEN 2 THEN '  ' WHEN 3 THEN title "
          "ELSE concat(' ', source, ' in the news ') END")


@query("good_title_batch",
       f"SELECT doc_id FROM (SELECT doc_id, {_TITLE.replace('title', 'lang || source')} AS v FROM documents) "
       "WHERE length(trim(v)) > 10 AND v <> 'nan'")
def _(spark, sf):
    rows = D.documents(spark, sf).selectExpr("doc_id", f"{_TITLE.replace('title', 'lang || source')} AS title")
    return Q.good_title(rows).select("doc_id")


@query("good_title_incremental",
       f"SELECT doc_id FROM (SELECT doc_id, {_TITLE.replace('title', 'lang || source')} AS v FROM documents) "
       "WHERE trim(v) <> ''")
def _(spark, sf):
    rows = D.documents(spark, sf).selectExpr("doc_id", f"{_TITLE.replace('title', 'lang || source')} AS title")
    return Q.good_title(rows, strict=False).select("doc_id")


@query("cleaning_funnel", f"""
WITH {D.CLEAN_CTES},
k1 AS (SELECT * FROM clean WHERE {D.sql_words('clean_text')} > 100),
k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) = 1),
k3 AS (SELECT * FROM k2 WHERE length(trim(title)) > 10 AND title <> 'nan'),
n AS (SELECT (SELECT count(*) FROM clean) AS n0, (SELECT count(*) FROM k1) AS n1,
             (SELECT count(*) FROM k2) AS n2, (SELECT count(*) FROM k3) AS n3)
SELECT 0 AS position, 'loaded' AS step, n0 AS kept, 0 AS removed FROM n
UNION ALL SELECT 1, 'min_words', n1, n0 - n1 FROM n
UNION ALL SELECT 2, 'unique_text', n2, n1 - n2 FROM n
UNION ALL SELECT 3, 'good_title', n3, n2 - n3 FROM n""")
def _(spark, sf):
    return Q.cleaning_funnel(D.cleaned(spark, sf), "doc_id")


@query("increment_funnel", f"""
WITH {D.CLEAN_CTES},
k1 AS (SELECT * FROM clean WHERE {D.sql_words('clean_text')} >= 100),
n AS (SELECT (SELECT count(*) FROM clean) AS n0, (SELECT count(*) FROM k1) AS n1,
             (SELECT count(*) FROM k1 WHERE trim(title) <> '') AS n2)
SELECT 0 AS position, 'loaded' AS step, n0 AS kept, 0 AS removed FROM n
UNION ALL SELECT 1, 'min_words', n1, n0 - n1 FROM n
UNION ALL SELECT 2, 'has_title', n2, n1 - n2 FROM n""")
def _(spark, sf):
    return I.step_counts(D.articles(spark, sf))


@query("require_columns",
       "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return Q.require(D.documents(spark, sf).join(labels, "doc_id", "left"), ["text", "quality"]).select("doc_id")


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf):
    return Q.value_counts(D.documents(spark, sf), "lang")


# == Web pages ==============================================================


@query("route_pages", D.with_pages(
    "SELECT page_id, CASE WHEN contains(url, 'cert-in.org.in') THEN 'advisory' ELSE 'generic' END AS route FROM p"))
def _(spark, sf):
    return P.routed(D.pages(spark, sf)).select("page_id", "route")


@query("html_only", D.with_pages("SELECT page_id FROM p WHERE lower(content_type) LIKE '%text/html%'"))
def _(spark, sf):
    return P.html_only(D.pages(spark, sf)).select("page_id")


_CHAR = "CASE WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 THEN chr(cast({n} AS int)) ELSE chr(65533) END"
_NUMERIC = ("array_to_string(list_transform(string_split({c}, '&#'), lambda s, i: CASE WHEN i = 1 THEN s "
            "WHEN regexp_matches(s, '^[0-9]{{1,9}};') THEN " + _CHAR.format(n="try_cast(split_part(s, ';', 1) AS bigint)") + " || substr(s, instr(s, ';') + 1) "
            "WHEN regexp_matches(s, '^[xX][0-9a-fA-F]{{1,7}};') THEN " + _CHAR.format(n="try_cast('0x' || substr(split_part(s, ';', 1), 2) AS bigint)")
            + " || substr(s, instr(s, ';') + 1) ELSE '&#' || s END), '')")
_UNESCAPE = ("replace(replace(replace(replace(replace(replace(" + _NUMERIC + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
             "'&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')")
_CLEAN_HTML = r"""clean AS (SELECT * REPLACE (regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>', chr(1), 'g') AS html) FROM p)"""
_QUOTED = """(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


def _sql_attribute(tag: str, name: str) -> str:
    """Raw value of a tag's attribute, null without it."""
    pairs = f"""list_filter(regexp_extract_all({tag}, '(?s)[^\\s=>"''/]+\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+)'), lambda x: regexp_matches(x, '(?i)^{name}\\s*='))[1]"""
    value = f"regexp_replace({pairs}, '^[^=]*=\\s*', '')"
    return f"""CASE WHEN left({value}, 1) IN ('"', '''') THEN {value}[2:-2] ELSE {value} END"""


def _sql_tags_of(name: str) -> str:
    return f"regexp_extract_all(html, '(?is)<{name}[\\s/]{_QUOTED}|<{name}[\\s/][^>]*>')"


# Segments of a path folded one by one.
_FOLDED = """list_reduce([[]::VARCHAR[]] || list_transform(string_split({path}, '/'), lambda s: [s]), lambda acc, s:
   CASE WHEN s[1] = '..' THEN acc[:len(acc) - 1] WHEN s[1] IN ('.', '') THEN acc ELSE acc || s END)"""


def _sql_resolved(page: str, href: str, source: str) -> str:
    """``source`` with ``target``: the absolute form of ``href`` on ``page``."""
    return f"""
SELECT *, CASE WHEN h0 = '' THEN pg
   WHEN regexp_matches(h0, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN h0
   WHEN starts_with(h0, '//') THEN regexp_extract(pg, '^(https?):', 1) || ':' || h0
   WHEN starts_with(h0, '#') THEN split_part(pg, '#', 1) || h0
   WHEN starts_with(h0, '?') THEN noq || h0
   ELSE origin || '/' || array_to_string(fold, '/') || CASE WHEN len(fold) > 0 AND (ends_with(way, '/') OR ends_with(way, '/.') OR ends_with(way, '/..')) THEN '/' ELSE '' END
        || substr(h0, length(own) + 1) END AS target
FROM (SELECT *, {_FOLDED.format(path='way')} AS fold FROM
  (SELECT *, CASE WHEN starts_with(own, '/') THEN own WHEN noq = origin THEN '/' || own ELSE regexp_replace(substr(noq, length(origin) + 1), '[^/]*$', '') || own END AS way FROM
    (SELECT *, {page} AS pg, trim({href}) AS h0, regexp_extract({page}, '^(https?://[^/?#]*)', 1) AS origin, regexp_replace({page}, '[?#].*$', '') AS noq,
            regexp_extract(trim({href}), '^([^?#]*)', 1) AS own FROM {source})))"""


_LINKS = f"""
{_CLEAN_HTML},
bases AS (SELECT page_id, url AS src_url, html, {_UNESCAPE.format(c="coalesce((" + _sql_attribute("list_filter(" + _sql_tags_of("base") + ", lambda x: regexp_matches(x, '(?i)href'))[1]", "href") + "), '')")} AS bh FROM clean),
based AS ({_sql_resolved('src_url', 'bh', 'bases')}),
tags AS (SELECT page_id, src_url, target AS base, {_sql_tags_of('a')} AS ts FROM based),
tag AS (SELECT page_id, src_url, base, unnest(generate_series(1, len(ts))) AS k, ts FROM tags WHERE len(ts) > 0),
raw AS (SELECT page_id, src_url, base, k, {_sql_attribute('ts[k]', 'href')} AS v FROM tag),
href AS (SELECT page_id, src_url, base, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, trim({_UNESCAPE.format(c='v')}) AS href FROM raw WHERE v IS NOT NULL),
abs AS (SELECT page_id, pos, src_url, href, target AS target_url FROM ({_sql_resolved('base', 'href', 'href')}))
"""


@query("page_links", D.with_pages("") + f", {_LINKS} SELECT page_id, pos, src_url, target_url FROM abs")
def _(spark, sf):
    return P.extract_links(D.pages(spark, sf)).select("page_id", long("pos").alias("pos"), "src_url", "target_url")


_PAGES_LINKS = D.with_pages("") + "," + _LINKS


@query("advisory_links", _PAGES_LINKS + """
SELECT page_id, pos, target_url, CASE WHEN regexp_matches(href, 'VLNOTE|ADVISORY|vlnotes|advisory') THEN 'advisory'
  ELSE 'index' END AS link_class FROM abs
WHERE contains(src_url, 'cert-in.org.in')
  AND regexp_matches(href, 'VLNOTE|ADVISORY|vlnotes|advisory|pageid=(PUBVLN|PUBADV)')""")
def _(spark, sf):
    index = P.routed(D.pages(spark, sf)).where("route = 'advisory'")
    return P.advisory_links(P.extract_links(index)).select(
        "page_id", long("pos").alias("pos"), "target_url", "link_class")


_HOST = "replace(lower(split_part(target_url, '/', 3)), 'www.', '')"
_SKIP = f"len(list_filter({D.sql_list(vocab.SKIP_URL_MARKS)}, lambda m: contains(lower(target_url), m))) > 0"
_HAS_HOST = "len(string_split(target_url, '/')) >= 3"
_ADMIT = {
    "suffix": f"{_HAS_HOST} AND NOT {_SKIP} AND len(list_filter({D.sql_list(vocab.BLOCKED_DOMAINS)}, "
              f"lambda d: {_HOST} = d OR ends_with({_HOST}, '.' || d))) = 0",
    "substring": f"{_HAS_HOST} AND NOT {_SKIP} AND len(list_filter({D.sql_list(vocab.BLOCKED_DOMAINS)}, "
                 f"lambda d: contains({_HOST}, d))) = 0",
}


@query("admissible_links_suffix", _PAGES_LINKS + f"SELECT page_id, pos, target_url FROM abs WHERE {_ADMIT['suffix']}")
def _(spark, sf):
    links = P.extract_links(D.pages(spark, sf))
    return links.where(U.is_article_url(F.col("target_url"))).select("page_id", long("pos").alias("pos"), "target_url")


@query("admissible_links_substring",
       _PAGES_LINKS + f"SELECT page_id, pos, target_url FROM abs WHERE {_ADMIT['substring']}")
def _(spark, sf):
    links = P.extract_links(D.pages(spark, sf))
    ok = links.where(U.is_article_url(F.col("target_url"), "substring"))
    return ok.select("page_id", long("pos").alias("pos"), "target_url")


@query("crawl_frontier", _PAGES_LINKS + f"""
SELECT target_url, page_id, pos FROM abs WHERE {_ADMIT['suffix']}
  AND target_url NOT IN (SELECT target_url FROM abs WHERE page_id % 7 = 0)
QUALIFY row_number() OVER (PARTITION BY target_url ORDER BY page_id, pos) = 1""")
def _(spark, sf):
    links = P.extract_links(D.pages(spark, sf))
    seen = links.where("page_id % 7 = 0").select(F.col("target_url").alias("url"))
    return P.frontier(links, seen).select("target_url", "page_id", long("pos").alias("pos"))


_VOIDS = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr'"
_BLOCKS = ("'p', 'div', 'ul', 'ol', 'dl', 'table', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'article', 'section', 'main', 'header', 'footer', 'nav', 'aside', "
           "'form', 'blockquote', 'pre', 'address', 'fieldset', 'center', 'hr'")
# Start tags, the open elements they end, and the elements an end does not reach beyond.
_IMPLIED_ENDS = [(_BLOCKS, "'p'", "''"), ("'li'", "'li'", "'ul', 'ol'"), ("'dd', 'dt'", "'dd', 'dt'", "'dl'"), ("'td', 'th'", "'td', 'th'", "'table', 'tr'"), ("'tr'", "'tr'", "'table'"),
                 ("'tbody', 'thead', 'tfoot'", "'tbody', 'thead', 'tfoot'", "'table'")]


def _sql_depth(names: str) -> str:
    """How far from the top of the stack the nearest of the names is; far away without one."""
    return f"coalesce(nullif(list_position(list_transform(list_reverse(stack), lambda e: e IN ({names})), true), 0), 1000000)"


def _sql_nodes(opening: str, min_chars: int) -> str:
    """Trimmed direct text nodes: tokens as rows, the open elements carried from row to row as a list."""
    ends = " ".join(f"WHEN nm IN ({starts}) AND {_sql_depth(closed)} < {_sql_depth(bar)} THEN stack[:len(stack) - {_sql_depth(closed)}]" for starts, closed, bar in _IMPLIED_ENDS)
    trimmed = f"trim({_UNESCAPE.format(c='n')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
    names = ", ".join(f"'{x}'" for x in opening.split("|"))
    return f"""
{_CLEAN_HTML},
toks AS (SELECT page_id, regexp_extract_all(html, '(?s)</?[a-zA-Z]{_QUOTED}|</?[a-zA-Z][^>]*>|[^<]+|<') AS ts FROM clean),
numbered AS (SELECT page_id, unnest(generate_series(1, len(ts))) AS i, ts FROM toks WHERE len(ts) > 0),
tok AS (SELECT page_id, i, ts[i] AS t, lower(regexp_extract(ts[i], '^</?([a-zA-Z][^\\s/>]*)', 1)) AS nm FROM numbered),
walk AS (
  SELECT page_id, 0 AS i, []::VARCHAR[] AS stack, '' AS t, false AS txt, false AS wanted FROM p
  UNION ALL
  SELECT page_id, i, CASE WHEN nm = '' OR left(t, 2) = '</' OR nm IN ({_VOIDS}) OR ends_with(t, '/>') THEN rest ELSE rest || [nm] END, t, nm = '', wanted FROM (
    SELECT tok.page_id, tok.i, tok.t, nm, stack[-1] IN ({names}) AS wanted,
      CASE WHEN nm = '' THEN stack
           WHEN left(tok.t, 2) = '</' THEN CASE WHEN list_contains(stack, nm) THEN stack[:len(stack) - list_position(list_reverse(stack), nm)] ELSE stack END
           {ends} ELSE stack END AS rest
    FROM walk JOIN tok ON tok.page_id = walk.page_id AND tok.i = walk.i + 1)),
runs AS (SELECT page_id, i, t, txt, wanted, sum(CASE WHEN txt THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS g FROM walk),
glued AS (SELECT page_id, g, string_split(string_agg(t, '' ORDER BY i), chr(1)) AS ns FROM runs WHERE txt AND wanted GROUP BY page_id, g),
nod AS (SELECT page_id, g, unnest(generate_series(1, len(ns))) AS j, ns FROM glued),
txt AS (SELECT page_id, g, j, ns[j] AS n FROM nod),
body AS (SELECT page_id, string_agg(v, ' ' ORDER BY g, j) AS content FROM
          (SELECT page_id, g, j, {trimmed} AS v FROM txt) WHERE length(v) > {min_chars} GROUP BY page_id)"""


def _sql_first(pattern: str) -> str:
    return f"nullif(regexp_extract(html, '{pattern}', 1), '')"


_OG = "(" + _sql_attribute("list_filter(" + _sql_tags_of("meta") + ", lambda x: (" + _sql_attribute("x", "property") + ") = 'og:title')[1]", "content") + ")"


@query("extract_articles", D.with_pages("") + "," + _sql_nodes("p", 40) + f""",
head AS (SELECT page_id, url, content_type,
  trim({_UNESCAPE.format(c="coalesce(nullif(" + _OG + ", ''), " + _sql_first('(?i)<title[^>]*>([^<]+)') + ", " + _sql_first('(?i)<h1[^>]*>([^<]+)') + ", '')")}) AS title FROM clean)
SELECT head.page_id, md5(url) AS id, title, url, content FROM head JOIN body ON head.page_id = body.page_id
WHERE lower(content_type) LIKE '%text/html%' AND length(title) >= 5 AND length(content) >= 200""")
def _(spark, sf):
    return P.extract_articles(D.pages(spark, sf))


@query("extract_advisories", D.with_pages("") + "," + _sql_nodes("td|p|li|span", 15) + f""",
head AS (SELECT page_id, url,
  trim({_UNESCAPE.format(c="coalesce(" + _sql_first('(?i)<h[234][^>]*>([^<]+)') + ", " + _sql_first('(?i)<title[^>]*>([^<]+)') + ", '')")}) AS title
  FROM clean WHERE contains(url, 'cert-in.org.in'))
SELECT head.page_id, md5(url) AS id, title, url, 'CERT-In' AS source,
       upper(regexp_extract(content, '(?i)(CI(?:VN|AD)-[0-9]{{4}}-[0-9]{{4,6}})', 1)) AS advisory_id,
       {D.sql_join(D.sql_cves('content'))} AS cves,
       CASE WHEN upper(regexp_extract(content, '{vocab.SEVERITY_PATTERN}', 1)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')
            THEN upper(regexp_extract(content, '{vocab.SEVERITY_PATTERN}', 1)) ELSE 'UNKNOWN' END AS severity,
       left(trim(regexp_extract(content, '{vocab.AFFECTED_PATTERN}', 1)), 200) AS affected,
       content
FROM head JOIN body ON head.page_id = body.page_id WHERE length(title) >= 5 AND length(content) >= 100""")
def _(spark, sf):
    index = P.routed(D.pages(spark, sf)).where("route = 'advisory'")
    return P.extract_advisories(index).withColumn("cves", X.join_list("cves"))


@query("advisory_fields", D.with_articles(f"""
SELECT doc_id, upper(regexp_extract(content, '(?i)(CI(?:VN|AD)-[0-9]{{4}}-[0-9]{{4,6}})', 1)) AS advisory_id,
       CASE WHEN upper(regexp_extract(content, '{vocab.SEVERITY_PATTERN}', 1)) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')
            THEN upper(regexp_extract(content, '{vocab.SEVERITY_PATTERN}', 1)) ELSE 'UNKNOWN' END AS severity,
       left(trim(regexp_extract(content, '{vocab.AFFECTED_PATTERN}', 1)), 200) AS affected FROM a"""))
def _(spark, sf):
    return P.advisory_fields(D.articles(spark, sf)).select("doc_id", "advisory_id", "severity", "affected")


@query("ingest_stamp", D.with_articles("SELECT doc_id, '2024-05-06T07:08:09.000000' AS crawled_at FROM a"))
def _(spark, sf):
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    return P.with_crawled_at(D.articles(spark, sf), at).select("doc_id", "crawled_at")


# == Entities ===============================================================


def _flat(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *[X.join_list(k).alias(k) for k in E.KINDS])


def _flat_sql(source: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{D.sql_join(k)} AS {k}" for k in E.KINDS) + f" FROM {source}"


@query("extract_entities", f"WITH {D.ENTITY_CTES} " + _flat_sql("ent"))
def _(spark, sf):
    return _flat(D.entities(spark, sf))


@query("entity_indicators",
       f"WITH {D.CLEAN_CTES} SELECT doc_id, {D.sql_join(D.sql_cves('clean_text'))} AS cve_ids, "
       f"{D.sql_join(D.sql_ips('clean_text'))} AS ip_addresses FROM clean")
def _(spark, sf):
    return D.cleaned(spark, sf).select(
        "doc_id", X.join_list(X.extract_cves("clean_text")).alias("cve_ids"),
        X.join_list(X.extract_ips("clean_text")).alias("ip_addresses"))


@query("gazetteer_terms", f"WITH {D.CLEAN_CTES},{D._TERMS} SELECT doc_id, kind, string_agg(term, ', ' ORDER BY term) "
       "AS terms FROM found GROUP BY doc_id, kind")
def _(spark, sf):
    rows = [("malware", t) for t in vocab.MALWARE_TERMS] + [("actor", t) for t in vocab.ACTOR_TERMS]
    gazetteer = spark.createDataFrame(rows, "kind string, term string")
    found = E.match_gazetteer(D.cleaned(spark, sf), "doc_id", gazetteer)
    return found.withColumn("terms", X.join_list("terms"))


# Every other document's words are the terms: far more than fit a list.
_WORD_TERMS = """
words AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'))) AS term FROM documents),
named AS (SELECT doc_id, term FROM words WHERE length(term) BETWEEN 4 AND 12)"""


@query("gazetteer_large", f"""WITH {_WORD_TERMS}, gaz AS (SELECT DISTINCT term FROM named WHERE doc_id % 2 = 0)
SELECT doc_id, count(*) AS n, md5(string_agg(term, ',' ORDER BY term)) AS terms FROM named JOIN gaz USING (term) GROUP BY doc_id""")
def _(spark, sf):
    rows = stage(spark, D.documents(spark, sf).select("doc_id", "text"), scratch(spark, "documents"))  # terms and texts read it
    words = rows.where("doc_id % 2 = 0").select(F.explode(F.split(F.lower("text"), FE.NOT_WORD_RUN)).alias("term"))
    terms = words.where(F.length("term").between(4, 12)).select(F.lit("word").alias("kind"), F.col("term")).distinct()
    terms = stage(spark, terms, scratch(spark, "terms"))  # a table, as gazetteers are
    found = E.match_gazetteer(rows, "doc_id", terms, column="text")
    return found.select("doc_id", long(F.size("terms")).alias("n"), F.md5(F.array_join(F.array_sort("terms"), ",")).alias("terms"))


_OWN = {"Hive": ["gang"], "Play": ["Display"], "WannaCry": ["bold"]}


@query("entities_own_terms", f"""WITH {D.CLEAN_CTES},
hit AS (SELECT doc_id, t.term, t.ctx, string_split(lower(clean_text), ' ') AS tk FROM clean,
        (VALUES ('hive', 'gang'), ('play', 'display'), ('wannacry', 'bold'), ('lazarus group', NULL)) t(term, ctx)
        WHERE regexp_matches(lower(clean_text), '\\b' || term || '\\b')),
near AS (SELECT doc_id, term, ctx, unnest(CASE WHEN ctx IS NULL THEN [0] ELSE list_filter(generate_series(1, len(tk)), lambda i: tk[i] = term) END) AS i, tk FROM hit),
kept AS (SELECT DISTINCT doc_id, term FROM near WHERE ctx IS NULL OR regexp_matches(array_to_string(tk[greatest(i - 10, 1):i + 10], ' '), '\\b' || ctx || '\\b'))
SELECT doc_id, string_agg(term, ', ' ORDER BY term) AS names FROM kept GROUP BY doc_id""")
def _(spark, sf):
    terms = [*_OWN, "LAZARUS Group"]
    found = E.extract_entities(D.cleaned(spark, sf), malware=terms, actors=["no such actor"], ambiguous=_OWN)
    return found.where(F.size("malware_names") > 0).select("doc_id", X.join_list("malware_names").alias("names"))


@query("ambiguity_guard", f"WITH {D.ENTITY_CTES} SELECT f.doc_id, f.term, b.term IS NOT NULL AS supported FROM found f "
       f"LEFT JOIN backed b ON f.doc_id = b.doc_id AND f.term = b.term WHERE f.kind = 'malware' "
       f"AND list_contains({D.sql_list(list(vocab.AMBIGUOUS_CONTEXTS))}, f.term)")
def _(spark, sf):
    worded = E.with_words(D.cleaned(spark, sf), "clean_text")
    hits = FE.match_terms(F.col("_lowered"), F.col("_words"), list(vocab.AMBIGUOUS_CONTEXTS))
    both = worded.select("doc_id", hits.alias("hits"), "_lowered").withColumn(
        "kept", FE.drop_unsupported(F.col("_lowered"), F.col("hits")))
    return both.select("doc_id", F.explode("hits").alias("term"), "kept").select(
        "doc_id", "term", F.array_contains("kept", F.col("term")).alias("supported"))


# A stand-in model: names picked by row number, some of them vendors or numbers.
_MODEL = ("CASE doc_id % 4 WHEN 0 THEN 'Microsoft,darkgate,12345' WHEN 1 THEN 'ab,darkgate,emotet' "
          "WHEN 2 THEN NULL ELSE 'palo alto,Zeus' END")


@query("combine_entities", f"""
WITH {D.ENTITY_CTES},
mod AS (SELECT doc_id, malware_names, threat_actors, coalesce(string_split({_MODEL}, ','), []) AS mm FROM ent),
un AS (SELECT doc_id, list_distinct(list_concat(malware_names, mm)) AS m, list_distinct(list_concat(threat_actors, mm)) AS t FROM mod)
SELECT doc_id,
  array_to_string(list_sort(list_filter(m, lambda e: NOT list_contains({D.sql_list(vocab.VENDOR_BLOCKLIST)}, lower(e)) AND length(e) > 2 AND NOT regexp_matches(e, '^[0-9]+$'))), ', ') AS malware_names,
  array_to_string(list_sort(list_filter(t, lambda e: NOT list_contains({D.sql_list(vocab.VENDOR_BLOCKLIST)}, lower(e)) AND length(e) > 2 AND NOT regexp_matches(e, '^[0-9]+$'))), ', ') AS threat_actors
FROM un""")
def _(spark, sf):
    rows = D.entities(spark, sf).withColumn("model", F.split(F.expr(_MODEL), ","))
    both = E.combine(rows, "model", "model")
    return both.select("doc_id", *[X.join_list(c).alias(c) for c in ("malware_names", "threat_actors")])


@query("combine_without_model", f"""
WITH {D.ENTITY_CTES} SELECT doc_id, {D.sql_join("list_filter(malware_names, lambda e: length(e) > 2)")} AS malware_names,
{D.sql_join("list_filter(threat_actors, lambda e: length(e) > 2)")} AS threat_actors FROM ent""")
def _(spark, sf):
    both = E.combine(D.entities(spark, sf))
    return both.select("doc_id", *[X.join_list(c).alias(c) for c in ("malware_names", "threat_actors")])


@query("entity_totals", f"""
WITH {D.ENTITY_CTES},
s AS (SELECT len(cve_ids) AS c, len(ip_addresses) AS i, len(malware_names) AS m, len(threat_actors) AS t FROM ent)
SELECT 'cve_ids' AS kind, cast(sum(c) AS bigint) AS total, count(*) FILTER (c > 0) AS articles FROM s
UNION ALL SELECT 'ip_addresses', cast(sum(i) AS bigint), count(*) FILTER (i > 0) FROM s
UNION ALL SELECT 'malware_names', cast(sum(m) AS bigint), count(*) FILTER (m > 0) FROM s
UNION ALL SELECT 'threat_actors', cast(sum(t) AS bigint), count(*) FILTER (t > 0) FROM s
UNION ALL SELECT 'any', cast(sum(c + i + m + t) AS bigint), count(*) FILTER (c + i + m + t > 0) FROM s""")
def _(spark, sf):
    return E.entity_totals(D.entities(spark, sf))


# == Sentences and BIO labels ===============================================

_SENT = f"""
sp AS (SELECT doc_id, unnest(generate_series(1, len(string_split_regex(raw_content, '[.\\n]')))) AS k,
              string_split_regex(raw_content, '[.\\n]') AS ss FROM clean),
sents AS (SELECT doc_id, k - 1 AS sent, list_filter(string_split_regex(ss[k], '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM sp)
"""


def _sentences(spark, sf, lo=8, hi=60, articles: DataFrame | None = None) -> DataFrame:
    return B.sentences(D.articles(spark, sf) if articles is None else articles, ["doc_id"], "content", lo, hi)


@query("sentences_training", f"WITH {D.CLEAN_CTES},{_SENT} SELECT doc_id, sent, array_to_string(words, ' ') AS sentence "
       "FROM sents WHERE len(words) BETWEEN 8 AND 60")
def _(spark, sf):
    return _sentences(spark, sf).select("doc_id", long("sent").alias("sent"),
                                        F.array_join("words", " ").alias("sentence"))


@query("sentences_inference", f"WITH {D.CLEAN_CTES},{_SENT} SELECT doc_id, sent, len(words) AS words "
       "FROM sents WHERE len(words) >= 3")
def _(spark, sf):
    return _sentences(spark, sf, 3, None).select("doc_id", long("sent").alias("sent"), long(F.size("words")).alias("words"))


def _write_order() -> list[tuple[int, str, str]]:
    mal = sorted(vocab.MALWARE_TERMS, key=len, reverse=True)
    act = sorted(vocab.ACTOR_TERMS, key=len, reverse=True)
    return [(i, k, t) for i, (k, t) in enumerate([("MALWARE", t) for t in mal] + [("ACTOR", t) for t in act])]


_BIO = f"""{_SENT},
tok AS (SELECT doc_id, sent, unnest(generate_series(1, len(words))) AS pos, words FROM sents WHERE len(words) BETWEEN 8 AND 60),
w AS (SELECT doc_id, sent, pos, words[pos] AS token, lower(words[pos]) AS low,
             lower(array_to_string(words[pos:pos + 1], ' ')) AS low2, pos < len(words) AS more FROM tok),
ord AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{t}')" for i, k, t in _write_order())}) AS v(rank, kind, term)),
hit AS (SELECT doc_id, sent, pos AS start, rank, kind, term, 1 AS n FROM w JOIN ord ON low = term
        UNION ALL SELECT doc_id, sent, pos, rank, kind, term, 2 FROM w JOIN ord ON low2 = term AND more AND contains(term, ' ')),
cov AS (SELECT doc_id, sent, start + o AS pos, rank, start, kind, o FROM hit, (VALUES (0), (1)) AS x(o) WHERE o < n),
lab AS (SELECT doc_id, sent, pos, CASE WHEN o = 0 THEN 'B-' ELSE 'I-' END || kind AS tag FROM cov
        QUALIFY row_number() OVER (PARTITION BY doc_id, sent, pos ORDER BY rank DESC, start DESC) = 1),
bio AS (SELECT w.doc_id, w.sent, w.pos - 1 AS pos, w.token, coalesce(tag, 'O') AS tag FROM w
        LEFT JOIN lab ON w.doc_id = lab.doc_id AND w.sent = lab.sent AND w.pos = lab.pos)
"""


@query("bio_labels", f"WITH {D.CLEAN_CTES},{_BIO} SELECT doc_id, sent, pos, token, tag FROM bio")
def _(spark, sf):
    flat = B.tokens(B.bio_label(_sentences(spark, sf)), ["doc_id"])
    return flat.withColumns({"sent": long("sent"), "pos": long("pos")})


# Abbreviations planted by row number: the sample texts have none.
_DOTTED_TEXT = ("concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN ' It cost approx. nine coins. The end came late.' "
                "WHEN 1 THEN ' They met Dr. Meyer, e.g. in town. The house (no. 5) stood.' WHEN 2 THEN ' Was it vs. them? It was...' ELSE '' END)")


def _dotted(spark, sf) -> DataFrame:
    return D.documents(spark, sf).selectExpr("doc_id", f"{_DOTTED_TEXT} AS text")


def _sql_type(token: str) -> str:
    bare = rf"""regexp_replace({token}, '^["''(\[]+|["'')\]]+$', '', 'g')"""
    word = rf"regexp_replace(lower({bare}), '\.$', '')"
    return f"CASE WHEN regexp_full_match({word}, '[-+]?[0-9][0-9.,]*') THEN '##' ELSE {word} END"


def _sql_dunning(both: str, left: str, right: str, total: str) -> str:
    def like(k: str, n: str, p: str) -> str:
        return (f"(CASE WHEN {k} > 0 THEN ({k}) * ln({p}) ELSE 0 END + CASE WHEN ({n}) - ({k}) > 0 THEN (({n}) - ({k})) * ln(1 - ({p})) ELSE 0 END)")

    p, inside, outside = f"({right}) / ({total})", f"({both}) / ({left})", f"(({right}) - ({both})) / (({total}) - ({left}))"
    ratio = (f"2 * ({like(both, left, inside)} + {like(f'({right}) - ({both})', f'({total}) - ({left})', outside)} "
             f"- {like(both, left, p)} - {like(f'({right}) - ({both})', f'({total}) - ({left})', p)})")
    return f"CASE WHEN {inside} > {p} THEN {ratio} ELSE 0 END"


_BOUNDARIES = rf"""
WITH lists AS (SELECT doc_id, list_filter(string_split_regex({_DOTTED_TEXT}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS t FROM documents),
flat AS (SELECT doc_id, unnest(t) AS token, unnest(list_concat(t[2:], [NULL])) AS next FROM lists),
tok AS (SELECT doc_id, token, next, {_sql_type('token')} AS word, {_sql_type('next')} AS following,
               regexp_replace(token, '["'')\]]+$', '') AS bare, ends_with(bare, '.') AND NOT ends_with(bare, '..') AS dotted FROM flat),
words AS (SELECT word, count(*) FILTER (dotted) AS c1, count(*) FILTER (NOT dotted) AS c0 FROM tok GROUP BY word),
sums AS (SELECT sum(c1 + c0)::DOUBLE AS total, sum(c1)::DOUBLE AS dots FROM words),
scored AS (SELECT word, c1, c0, length(replace(word, '.', '')) AS letters,
             2 * (c1 * ln(0.99) + c0 * ln(1 - 0.99) - c1 * ln(dots / total) - c0 * ln(1 - dots / total))
               * exp(-letters) * (length(word) - letters + 1) * pow(letters, -c0) AS score
           FROM words, sums WHERE c1 > 0 AND word <> '##' AND letters > 0),
abbr AS (SELECT * FROM scored WHERE score >= 0.3),
pairs AS (SELECT word, following, count(*)::DOUBLE AS n FROM tok WHERE dotted AND following <> '' GROUP BY word, following),
behind AS (SELECT * FROM pairs WHERE word <> '##' AND word NOT IN (SELECT word FROM abbr)),
follows AS (SELECT following AS w, sum(n) AS k, (SELECT sum(n) FROM behind) AS breaks FROM behind GROUP BY following),
starts AS (SELECT w FROM follows JOIN words ON word = w, sums WHERE w <> '##' AND {_sql_dunning('k', 'breaks', '(c1 + c0)::DOUBLE', 'total')} >= 30),
tied AS (SELECT p.word, p.following FROM pairs p JOIN words l ON l.word = p.word JOIN words r ON r.word = p.following, sums
         WHERE (p.word = '##' OR p.word IN (SELECT word FROM abbr)) AND p.following <> '##' AND p.following NOT IN (SELECT w FROM starts)
           AND {_sql_dunning('p.n', 'l.c1::DOUBLE', '(r.c1 + r.c0)::DOUBLE', 'total')} >= 7.88),
ends AS (SELECT doc_id, CASE
    WHEN next IS NULL THEN true
    WHEN NOT regexp_matches(bare, '[.?!]$') THEN false
    WHEN NOT ends_with(bare, '.') THEN true
    WHEN NOT dotted THEN lead <> lower(lead)
    WHEN (word, following) IN (SELECT (word, following) FROM tied) THEN false
    WHEN word IN (SELECT word FROM abbr) THEN lead <> lower(lead) AND following IN (SELECT w FROM starts)
    WHEN word = '##' THEN lead = upper(lead)
    ELSE true END AS stop
  FROM (SELECT *, substr(regexp_replace(next, '^["''(\[]+', ''), 1, 1) AS lead FROM tok))
"""


@query("abbreviations", _BOUNDARIES + "SELECT word, c1 AS with_period, c0 AS without_period, round(score, 4) AS score FROM abbr")
def _(spark, sf):
    found = S.learn_boundaries(_dotted(spark, sf)).abbreviations
    return found.select("word", "with_period", "without_period", F.round("score", 4).alias("score"))


@query("sentence_starters", _BOUNDARIES + "SELECT '' AS word, w AS following FROM starts UNION ALL SELECT word, following FROM tied")
def _(spark, sf):
    """Words that begin sentences, and pairs that are tied over a period."""
    model = S.learn_boundaries(_dotted(spark, sf))
    return model.starters.select(F.lit("").alias("word"), F.col("word").alias("following")).unionByName(model.collocations)


@query("learnt_sentences", _BOUNDARIES + "SELECT doc_id, count(*) FILTER (stop) AS n_sentences FROM ends GROUP BY doc_id")
def _(spark, sf):
    rows = stage(spark, _dotted(spark, sf), scratch(spark, "dotted"))
    out = S.split_sentences(rows, S.learn_boundaries(rows), ["doc_id"])
    return out.where(F.size("sentences") > 0).select("doc_id", long(F.size("sentences")).alias("n_sentences"))


@query("ner_training_sample", f"""
WITH {D.CLEAN_CTES},{_BIO},
per AS (SELECT doc_id, sent, count(*) FILTER (tag <> 'O') AS entity_tokens FROM bio GROUP BY doc_id, sent),
plain AS (SELECT doc_id, sent, row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || sent), doc_id, sent) AS r
          FROM per WHERE entity_tokens = 0)
SELECT doc_id, sent, entity_tokens FROM per WHERE entity_tokens > 0
UNION ALL SELECT doc_id, sent, 0 FROM plain
WHERE r <= (SELECT least(count(*), 2000) FROM per WHERE entity_tokens > 0)""")
def _(spark, sf):
    # The sample reads its input several times (count, prefix sizes, rows): label once, write, read.
    sample = B.ner_training_sample(stage(spark, B.bio_label(_sentences(spark, sf)), scratch(spark, "bio")), ["doc_id"])
    n = F.size(F.filter("tags", lambda t: t != "O"))
    return sample.select("doc_id", long("sent").alias("sent"), long(n).alias("entity_tokens"))


_SAMPLE = f"""
WITH {D.CLEAN_CTES},{_BIO},
per AS (SELECT doc_id, sent, count(*) FILTER (tag <> 'O') AS entity_tokens FROM bio GROUP BY doc_id, sent),
plain AS (SELECT doc_id, sent, row_number() OVER (ORDER BY md5('42|' || doc_id || '|' || sent), doc_id, sent) AS r FROM per WHERE entity_tokens = 0),
chosen AS (SELECT doc_id, sent FROM per WHERE entity_tokens > 0
           UNION ALL SELECT doc_id, sent FROM plain WHERE r <= (SELECT least(count(*), 2000) FROM per WHERE entity_tokens > 0)),
part AS (SELECT doc_id, sent, substr(md5('42|' || doc_id || '|' || sent), 1, 8) < 'e6666666' AS train FROM chosen)
"""


def _tagger_parts(spark, sf, articles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    sample = B.ner_training_sample(stage(spark, B.bio_label(_sentences(spark, sf, articles=articles)), scratch(spark, "bio")), ["doc_id"])
    return R.split(stage(spark, sample, scratch(spark, "sample")), ["doc_id", "sent"], 0.9)


@query("train_tagger", _SAMPLE + """
SELECT (SELECT count(*) FROM part WHERE train) AS train_sentences, (SELECT count(*) FROM part WHERE NOT train) AS test_sentences,
       count(*) AS test_tokens, round(avg(CASE WHEN tag = 'O' THEN 1.0 ELSE 0 END), 4) AS majority_accuracy, true AS above_majority,
       true AS names_found
FROM bio JOIN part USING (doc_id, sent) WHERE NOT train""")
def _(spark, sf):
    train, test = _tagger_parts(spark, sf)
    model = N.train_tagger(train, ["doc_id"])
    tagged = N.tag_sentences(test, model, ["doc_id"]).withColumnRenamed("tags", "pred")
    both = tagged.join(test.select("doc_id", "sent", "tags"), ["doc_id", "sent"])
    flat = both.select("doc_id", "sent", F.inline(F.arrays_zip(F.col("tags").alias("tag"), F.col("pred").alias("pred"))))
    right, named = F.count_if(F.col("tag") == F.col("pred")), F.count_if((F.col("tag") != "O") & (F.col("tag") == F.col("pred")))
    counts = flat.agg(F.count("*").alias("test_tokens"), F.count_if(F.col("tag") == "O").alias("plain"), right.alias("right"), named.alias("named"))
    return counts.select(
        train.agg(F.count("*").alias("n")).scalar().alias("train_sentences"), test.agg(F.count("*").alias("n")).scalar().alias("test_sentences"), "test_tokens",
        F.round(F.col("plain") / F.col("test_tokens"), 4).alias("majority_accuracy"), (F.col("right") > F.col("plain")).alias("above_majority"),
        # nine of ten tokens of names bear the right tag
        (F.col("named") >= 0.9 * (F.col("test_tokens") - F.col("plain"))).alias("names_found"))


@query("tag_sentences", f"WITH {D.CLEAN_CTES},{_SENT} SELECT doc_id, sent, len(words) AS tags, true AS consistent FROM sents WHERE len(words) >= 3")
def _(spark, sf):
    articles = stage(spark, D.articles(spark, sf).select("doc_id", "content"), scratch(spark, "articles"))  # training and tagging read it
    model = N.train_tagger(_tagger_parts(spark, sf, articles)[0], ["doc_id"])
    tagged = N.tag_sentences(_sentences(spark, sf, 3, None, articles), model, ["doc_id"])
    before = F.concat(F.array(F.lit("O")), F.slice("tags", 1, F.size("tags") - 1))
    continues = F.zip_with("tags", before, lambda t, b: ~t.startswith("I-") | ((b != "O") & (F.substring(t, 3, 9) == F.substring(b, 3, 9))))
    return tagged.select("doc_id", long("sent").alias("sent"), long(F.size("tags")).alias("tags"), F.forall(continues, lambda c: c).alias("consistent"))


# Arbitrary tag sequences, spelled from the position, to exercise every transition.
@query("bio_decode", f"""
WITH {D.CLEAN_CTES},{_SENT},
tok AS (SELECT doc_id, sent, unnest(generate_series(1, len(words))) AS pos, words FROM sents WHERE len(words) BETWEEN 8 AND 60),
tg AS (SELECT doc_id, sent, pos, words[pos] AS token,
         {D.sql_list(vocab.BIO_TAGS)}[1 + (doc_id * 7 + sent * 3 + (pos - 1) * (1 + doc_id % 4)) % 5] AS tag FROM tok),
g AS (SELECT *, count(*) FILTER (tag LIKE 'B-%') OVER (PARTITION BY doc_id, sent ORDER BY pos) AS grp FROM tg),
f AS (SELECT *, first_value(substr(tag, 3)) OVER (PARTITION BY doc_id, sent, grp ORDER BY pos) AS kind,
        min(pos) OVER (PARTITION BY doc_id, sent, grp) AS start FROM g WHERE grp > 0),
brk AS (SELECT *, count(*) FILTER (pos > start AND tag <> 'I-' || kind)
          OVER (PARTITION BY doc_id, sent, grp ORDER BY pos) AS broken FROM f)
SELECT doc_id, sent, grp - 1 AS span, CASE WHEN any_value(kind) = 'MALWARE' THEN 'malware' ELSE 'actor' END AS kind,
       lower(string_agg(token, ' ' ORDER BY pos)) AS entity
FROM brk WHERE broken = 0 GROUP BY doc_id, sent, grp""")
def _(spark, sf):
    names = F.array(*[F.lit(t) for t in vocab.BIO_TAGS])
    base = F.col("doc_id") * 7 + F.col("sent") * 3
    step = F.lit(1) + F.col("doc_id") % 4
    tags = F.transform("words", lambda w, i: F.element_at(names, ((base + i * step) % 5 + 1).cast("int")))
    spans = B.decode(_sentences(spark, sf).withColumn("tags", tags), ["doc_id"])
    return spans.withColumns({"sent": long("sent"), "span": long("span")})


@query("token_accuracy", """
WITH t AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -100 ELSE doc_id % 5 END AS label, (doc_id * doc_id) % 5 AS pred FROM documents)
SELECT round(count(*) FILTER (label = pred) / count(*), 4) AS token_accuracy FROM t WHERE label <> -100""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "CASE WHEN doc_id % 3 = 0 THEN -100 ELSE doc_id % 5 END AS label", "(doc_id * doc_id) % 5 AS pred")
    return B.token_accuracy(rows)


# == Classification =========================================================


@query("model_input",
       f"WITH {D.CLEAN_CTES} SELECT doc_id, trim(title) || '. ' || substr(trim(clean_text), 1, 300) AS txt FROM clean")
def _(spark, sf):
    return D.cleaned(spark, sf).select("doc_id", C.model_input().alias("txt"))


def _sql_scores(labels: list[str], have: str, multi: bool) -> str:
    """CTE rows (doc_id, i, label, score) for each label."""
    want = ", ".join(f"({i}, '{x}', {D.sql_list(sorted(set(C._words(x))))})" for i, x in enumerate(labels))
    sim = f"len(list_intersect({have}, want)) / sqrt(greatest(len({have}), 1)::double * len(want))"
    if multi:
        score = f"1.0 / (1.0 + exp(-8.0 * ({sim} - 0.1)))"
    else:
        score = f"exp(8.0 * {sim}) / sum(exp(8.0 * {sim})) OVER (PARTITION BY doc_id)"
    return f"SELECT doc_id, i, label, {score} AS score FROM inp, (VALUES {want}) AS v(i, label, want)"


@query("bootstrap_tags", f"""
WITH {D.CLEAN_CTES},
inp AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(
          trim(title) || ' malware threat. ' || substr(trim(clean_text), 1, 300)), '[^a-z0-9]+'), lambda w: w <> '')) AS have FROM clean),
b AS ({_sql_scores([vocab.THREAT_LABEL, vocab.UNRELATED_LABEL], "have", False)}),
top AS (SELECT doc_id, label, score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1),
n AS ({_sql_scores(vocab.INDUSTRIES, "have", True)}),
r AS (SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM n)
SELECT top.doc_id, round(top.score, 4) AS threat_score, r1.label AS primary_industry, round(r1.score, 4) AS industry_score,
       CASE WHEN r2.score > 0.40 THEN r2.label ELSE '' END AS secondary_industry
FROM top JOIN r r1 ON r1.doc_id = top.doc_id AND r1.k = 1 JOIN r r2 ON r2.doc_id = top.doc_id AND r2.k = 2
WHERE NOT contains(top.label, 'general unrelated') AND top.score >= 0.55""")
def _(spark, sf):
    rows = D.cleaned(spark, sf).drop("primary_industry", "threat_score")
    rows = rows.withColumn("title", F.concat("title", F.lit(" malware threat")))
    return C.bootstrap_tags(rows).select(
        "doc_id", "threat_score", "primary_industry", "industry_score", "secondary_industry")


@query("pick_labels", """
WITH s AS (SELECT doc_id, (doc_id * 37 % 1000) / 1000.0 AS b, (doc_id * 53 % 1000) / 1000.0 AS i1,
                  (doc_id * 53 % 1000) / 2000.0 + 0.2 AS i2,
                  CASE WHEN doc_id % 4 = 0 THEN 'general unrelated non-security content' ELSE 'threat' END AS l FROM documents)
SELECT doc_id, round(b, 4) AS threat_score, 'Finance' AS primary_industry, round(i1, 4) AS industry_score,
       CASE WHEN i2 > 0.40 THEN 'ICS' ELSE '' END AS secondary_industry
FROM s WHERE l = 'threat' AND b >= 0.55""")
def _(spark, sf):
    d = "(cast(doc_id * {} % 1000 AS double) / {}.0D{})"
    one = "array(named_struct('label', {}, 'score', {}), named_struct('label', 'ICS', 'score', {}))"
    unrelated = "CASE WHEN doc_id % 4 = 0 THEN 'general unrelated non-security content' ELSE 'threat' END"
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id",
        one.format(unrelated, d.format(37, 1000, ""), "0.0D") + " AS binary",
        one.format("'Finance'", d.format(53, 1000, ""), d.format(53, 2000, " + 0.2D")) + " AS industry")
    return C.pick_labels(rows)


@query("balanced_training_set", f"""
WITH pos AS (SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id
             WHERE toxic = 1 AND {D.sql_words('text')} > 30),
neg AS (SELECT d.doc_id, row_number() OVER (ORDER BY md5('42|' || d.doc_id), d.doc_id) AS r
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0)
SELECT doc_id, 1 AS label FROM pos UNION ALL SELECT doc_id, 0 FROM neg WHERE r <= (SELECT count(*) FROM pos)""")
def _(spark, sf):
    rows = _labelled(spark, sf)
    return C.balanced_training_set(rows.where("toxic = 1"), rows.where("toxic = 0"), "doc_id").select("doc_id", "label")


def _labelled(spark, sf) -> DataFrame:
    return D.documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


@query("label_encoding", D.with_articles(
    "SELECT doc_id, primary_industry, dense_rank() OVER (ORDER BY primary_industry) - 1 AS label_id FROM a"))
def _(spark, sf):
    rows = C.encode_labels(D.articles(spark, sf), "primary_industry")
    return rows.select("doc_id", "primary_industry", long("label_id").alias("label_id"))


@query("class_weights", "SELECT lang, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight "
       "FROM documents GROUP BY lang")
def _(spark, sf):
    weights = C.class_weights(spark.read.parquet(f"{sf}/documents.parquet"), "lang")
    return weights.withColumn("weight", F.round("weight", 6))


def _split_sql(edge: str) -> str:
    return (f"SELECT doc_id, CASE WHEN substr(md5('42|' || doc_id), 1, 8) < '{edge}' THEN 'train' ELSE 'test' END AS part "
            "FROM documents")


def _split(spark, sf, fraction) -> DataFrame:
    train, test = R.split(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), ["doc_id"], fraction)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("split_classifier", _split_sql("cccccccc"))
def _(spark, sf):
    return _split(spark, sf, 0.8)


@query("split_ner", _split_sql("e6666666"))
def _(spark, sf):
    return _split(spark, sf, 0.9)


@query("evaluate", """
WITH t AS (SELECT doc_id % 7 AS label, CASE WHEN doc_id % 3 = 0 THEN (doc_id * doc_id) % 7 ELSE doc_id % 7 END AS p FROM documents),
c AS (SELECT v AS cls, (SELECT count(*) FROM t WHERE label = v) AS s, (SELECT count(*) FROM t WHERE p = v) AS q,
             (SELECT count(*) FROM t WHERE label = v AND p = v) AS h FROM (SELECT unnest(range(7)) AS v))
SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(s * 2.0 * h / (s + q)) / sum(s), 6) AS weighted_f1 FROM c""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id % 7 AS label", "CASE WHEN doc_id % 3 = 0 THEN (doc_id * doc_id) % 7 ELSE doc_id % 7 END AS prediction")
    return C.evaluate(rows)


def _binary_training(spark, sf) -> DataFrame:
    rows = _labelled(spark, sf).withColumn("label", F.col("quality").cast("int"))
    return rows.select("doc_id", "text", "label")


def _industry_training(spark, sf, clean: DataFrame | None = None) -> DataFrame:
    rows = (D.cleaned(spark, sf) if clean is None else clean).select("doc_id", C.model_input().alias("text"), "primary_industry")
    return C.encode_labels(rows, "primary_industry", C.label_map(D.articles(spark, sf), "primary_industry"))


@query("train_binary")
def _(spark, sf):
    """Accuracy and F1 of the binary model on the held-out fifth."""
    train, test = R.split(_binary_training(spark, sf), ["doc_id"])
    return C.evaluate(C.predict(test, C.train_binary(train)))


@query("train_industry")
def _(spark, sf):
    train, test = R.split(_industry_training(spark, sf), ["doc_id"])
    model = C.train_industry(train)
    return C.evaluate(C.predict(test, model), "label_id")


@query("predict_binary")
def _(spark, sf):
    rows = _binary_training(spark, sf)
    return C.predict(rows, C.train_binary(rows)).select("doc_id", "prediction", F.round("confidence", 4).alias("confidence"))


@query("tag_articles")
def _(spark, sf):
    models, clean = _models(spark, sf)
    tagged = C.tag_articles(clean, models.binary, models.industry, models.labels)
    return tagged.select("doc_id", "threat_score", "primary_industry", "industry_score")


def _models(spark, sf):
    from intelweave.plans.batch import Models

    clean = stage(spark, D.cleaned(spark, sf), scratch(spark, "cleaned"))  # three fits and the tagging read it
    labelled = clean.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    binary = C.train_binary(labelled.select(C.model_input().alias("text"), F.col("quality").cast("int").alias("label")))
    labels = C.label_map(D.articles(spark, sf), "primary_industry")
    industry = C.train_industry(_industry_training(spark, sf, clean))
    untagged = clean.drop("primary_industry", "threat_score")
    return Models(binary, industry, labels, V.fit_embedder(clean)), untagged


# Texts whose class can be read off planted words: what a model has to learn, SQL can say.


def _planted(spark, sf) -> DataFrame:
    rows = D.cleaned(spark, sf).drop("threat_score").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    names = F.array(F.concat(F.lit("class"), F.col("quality").cast("string")), F.regexp_replace("primary_industry", " ", ""))
    # Forty words of its own for each class: one alone would not outweigh what the other words overfit.
    words = F.flatten(F.transform(names, lambda n: F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(n, F.lit("_"), i.cast("string")))))
    rows = rows.withColumns({"title": F.concat_ws(" ", words, "title"), "label": F.col("quality").cast("int")})
    return stage(spark, rows.withColumn("text", C.model_input()), scratch(spark, "planted"))


_PLANTED = D.with_articles("""SELECT a.doc_id, {columns} FROM a JOIN labels l ON a.doc_id = l.doc_id
WHERE substr(md5('42|' || a.doc_id), 1, 8) >= 'cccccccc' {where}""")


@query("train_binary_planted", _PLANTED.format(columns="cast(quality AS int) AS prediction, true AS likelier", where=""))
def _(spark, sf):
    """Class of each held-out article by a model of the others, and whether its probability is over a half."""
    train, test = R.split(_planted(spark, sf), ["doc_id"])
    return C.predict(test, C.train_binary(train)).select("doc_id", "prediction", (F.col("confidence") > 0.5).alias("likelier"))


@query("train_industry_planted", _PLANTED.format(columns="primary_industry AS predicted, true AS likelier", where=""))
def _(spark, sf):
    rows = _planted(spark, sf)
    names = C.label_map(D.articles(spark, sf), "primary_industry")
    train, test = R.split(C.encode_labels(rows.drop("label"), "primary_industry", names), ["doc_id"])
    out = C.predict(test, C.train_industry(train)).join(names.withColumnRenamed("label_id", "prediction"), "prediction")
    return out.select("doc_id", F.col("label").alias("predicted"), (F.col("confidence") > 1 / 7).alias("likelier"))


@query("tag_articles_planted", _PLANTED.format(
    columns="primary_industry, true AS threat, true AS scored", where="AND quality = 1"))
def _(spark, sf):
    """The cascade over held-out articles: those of class 1 with their industry."""
    names = C.label_map(D.articles(spark, sf), "primary_industry")
    train, test = R.split(_planted(spark, sf), ["doc_id"])
    industry = C.train_industry(C.encode_labels(train.drop("label"), "primary_industry", names))
    tagged = C.tag_articles(test.drop("text", "label", "primary_industry"), C.train_binary(train), industry, names)
    return tagged.select("doc_id", "primary_industry", F.col("threat_score").between(0.5, 1).alias("threat"), F.col("industry_score").between(0, 1).alias("scored"))


# == Vectors ================================================================


@query("embed_documents", "SELECT doc_id, 384 AS dim, 1.0 AS squared_norm FROM documents")
def _(spark, sf):
    clean = D.cleaned(spark, sf)
    out = V.embed(clean, V.fit_embedder(clean))
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4)
    return out.select("doc_id", long(F.size("embedding")).alias("dim"), norm.alias("squared_norm"))


@query("embed_latent", D.with_articles("""
SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(content, '[A-Za-z0-9]') THEN 1.0 ELSE 0.0 END AS squared_norm FROM a"""))
def _(spark, sf):
    words = F.regexp_replace("content", "[^A-Za-z0-9]+", " ").alias("words")
    rows = stage(spark, D.articles(spark, sf).select("doc_id", words), scratch(spark, "latent"))
    out = L.embed_latent(rows, L.fit_latent(rows, "words"))
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4)
    return out.select("doc_id", long(F.size("embedding")).alias("dim"), norm.alias("squared_norm"))


@query("rebuild_vectors", f"WITH {D.COLLECTION_CTES} SELECT id, title, url, len(embedding) AS dim FROM col")
def _(spark, sf):
    path = scratch(spark, "vectors")
    stores.write_vectors(D.collection(spark, sf).drop("doc_id"), path, "rebuild")
    return stores.read_vectors(spark, path).select("id", "title", "url", long(F.size("embedding")).alias("dim"))


@query("add_vectors", f"WITH {D.COLLECTION_CTES} SELECT id, url FROM col WHERE doc_id % 3 <> 0")
def _(spark, sf):
    rows = D.collection(spark, sf)
    return V.add_vectors(rows.unionByName(rows.where("doc_id % 5 = 0")), rows.where("doc_id % 3 = 0")).select("id", "url")


@query("vector_metadata", D.with_articles(
    "SELECT id, title, url, cast(threat_score AS varchar) AS threat_score, "
    "CASE WHEN doc_id % 9 = 0 THEN '' ELSE primary_industry END AS primary_industry, '' AS industry_score FROM a"))
def _(spark, sf):
    rows = D.articles(spark, sf).withColumns({
        "primary_industry": F.when(F.col("doc_id") % 9 != 0, F.col("primary_industry")),
        "industry_score": F.lit(None).cast("double")})
    return V.vector_metadata(rows)


_DIST = ("list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))")


def _query_vector(df: DataFrame):
    return df.where("doc_id = 0").select("embedding").scalar()


@query("knn_search", f"""
WITH {D.COLLECTION_CTES}, s AS (SELECT *, {_DIST} AS d FROM col, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))
SELECT doc_id, round(d, 6) AS distance, round(greatest(0.0, 1 - d / 2), 3) AS similarity FROM s ORDER BY d, id LIMIT 10""")
def _(spark, sf):
    rows = D.collection(spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    top = V.knn(rows, _query_vector(vectors), 10)
    return top.select("doc_id", F.round("distance", 6).alias("distance"), "similarity")


@query("knn_search_industry", f"""
WITH {D.COLLECTION_CTES}, s AS (SELECT *, {_DIST} AS d FROM col, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))
SELECT doc_id, round(d, 6) AS distance FROM s WHERE primary_industry = 'Finance' ORDER BY d, id LIMIT 7""")
def _(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    top = V.knn(D.collection(spark, sf), _query_vector(vectors), 7, "Finance")
    return top.select("doc_id", F.round("distance", 6).alias("distance"))


@query("knn_join", """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(generate_series(1, len(a.embedding)),
             lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS d
           FROM embeddings a, embeddings b)
SELECT query_id, id, round(d, 6) AS distance, round(greatest(0.0, 1 - d / 2), 3) AS similarity FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 5""")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    near = K.knn_join(rows, rows, 5, "vec_id")
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), "similarity")


@query("similarity_scores", f"""
WITH s AS (SELECT vec_id, {_DIST} AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))
SELECT vec_id, round(greatest(0.0, 1 - d / 2), 3) AS similarity FROM s""")
def _(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.withColumn("q", vectors.where("vec_id = 0").select("embedding").scalar())
    return asked.select("vec_id", similarity(squared_distance(F.col("embedding"), F.col("q"))).alias("similarity"))


_SEARCH = f"""
WITH {D.COLLECTION_CTES}, s AS (SELECT *, {_DIST} AS d FROM col, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))
SELECT title, url, substr(document, 1, 300) AS snippet, round(greatest(0.0, 1 - d / 2), 3) AS similarity_score,
       threat_score, primary_industry FROM s"""


def _searched(spark, sf, industry) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    return A.search_by_vector(D.collection(spark, sf), _query_vector(vectors), industry)


@query("search", _SEARCH + " ORDER BY d, id LIMIT 5")
def _(spark, sf):
    return _searched(spark, sf, "All Industries")


@query("search_industry", _SEARCH + " WHERE primary_industry = 'Healthcare' ORDER BY d, id LIMIT 5")
def _(spark, sf):
    return _searched(spark, sf, "Healthcare")


@query("search_text")
def _(spark, sf):
    clean = D.cleaned(spark, sf).withColumn("industry_score", F.lit(0.5))
    model = V.fit_embedder(clean)
    return A.search(V.vector_rows(V.embed(clean, model)), "lazarus group emotet cobalt strike", model)


@query("describe_vectors", "SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
def _(spark, sf):
    out = V.describe_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return out.withColumns({"min_dim": long("min_dim"), "max_dim": long("max_dim")})


@query("peek_vectors", f"WITH {D.COLLECTION_CTES} SELECT id, title, len(embedding) AS dim FROM col ORDER BY id LIMIT 3")
def _(spark, sf):
    return V.peek(D.collection(spark, sf)).select("id", "title", long(F.size("embedding")).alias("dim"))


# == Graph ==================================================================

_G = f"WITH {D.GRAPH_CTES} "


def _graph_query(name: str, where: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: fn(D.entities(spark, sf))
    ORACLES[name] = _G + f"SELECT * FROM edges WHERE {where}"


_graph_query("graph_mentions", "rel = 'MENTIONS'", G.mentions)
_graph_query("graph_article_targets", "rel = 'TARGETS' AND src_label = 'Article'", G.article_targets)
_graph_query("graph_actor_uses", "rel = 'USES'", G.actor_uses)
_graph_query("graph_malware_exploits", "rel = 'EXPLOITS'", G.malware_exploits)
_graph_query("graph_actor_targets", "rel = 'TARGETS' AND src_label = 'ThreatActor'", G.actor_targets)
_graph_query("graph_actor_infrastructure", "rel = 'USES_INFRASTRUCTURE'", G.actor_infra)
_graph_query("graph_edges", "true", G.graph_edges)


@query("graph_articles", _G + "SELECT doc_id FROM ga")
def _(spark, sf):
    return G.graph_articles(D.entities(spark, sf)).select("doc_id")


def _revisited(spark, sf) -> DataFrame:
    """Every URL twice: the later row (by ``seq``) carries the next industry."""
    rows = D.entities(spark, sf).withColumn("seq", F.col("doc_id"))
    again = rows.where("doc_id % 5 = 0").withColumns(
        {"seq": F.col("doc_id") + 1_000_000, "primary_industry": F.lit("Finance"), "threat_score": F.lit(0.5)})
    return rows.unionByName(again)


@query("graph_article_nodes", _G + """SELECT 'Article' AS label, url AS key, title,
  CASE WHEN doc_id % 5 = 0 THEN 'Finance' ELSE primary_industry END AS industry,
  CASE WHEN doc_id % 5 = 0 THEN '0.5' ELSE cast(threat_score AS varchar) END AS threat_score FROM ga""")
def _(spark, sf):
    return G.article_nodes(_revisited(spark, sf), "seq")


@query("graph_entity_nodes", _G + "SELECT DISTINCT dst_label AS label, dst AS key FROM edges")
def _(spark, sf):
    return G.entity_nodes(D.entities(spark, sf)).select("label", "key")


@query("graph_nodes", _G + "SELECT label, key, title, industry, threat_score FROM nodes")
def _(spark, sf):
    return _graph(spark, sf)[0]


@query("graph_rebuild", _G + "SELECT 'node' AS part, label AS name, count(*) AS n FROM nodes GROUP BY label "
       "UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel")
def _(spark, sf):
    path = scratch(spark, "graph")
    stores.write_graph(*_graph(spark, sf), path)
    nodes, edges = stores.read_graph(spark, path)
    return G.graph_summary(nodes, edges).where("name <> '(total)'")


@query("graph_merge", _G + """,
fresh AS (SELECT DISTINCT src_label, src, rel, dst_label, CASE WHEN dst_label = 'Industry' THEN 'Finance' ELSE dst END AS dst
          FROM edges WHERE src_label = 'Article' AND src IN (SELECT url FROM ga WHERE doc_id % 5 = 0)),
alle AS (SELECT src_label, src, rel, dst_label, dst FROM edges UNION SELECT src_label, src, rel, dst_label, dst FROM fresh
         UNION SELECT 'ThreatActor', a.dst, 'TARGETS', 'Industry', 'Finance' FROM fresh a WHERE a.dst_label = 'ThreatActor'),
alln AS (SELECT label, key, CASE WHEN label = 'Article' AND key IN (SELECT src FROM fresh) THEN 'Finance' ELSE industry END AS industry FROM nodes)
SELECT 'edge' AS part, rel AS name, dst AS detail, count(*) AS n FROM alle GROUP BY rel, dst
UNION ALL SELECT 'node', label, coalesce(industry, ''), count(*) FROM alln GROUP BY label, coalesce(industry, '')""")
def _(spark, sf):
    rows = stage(spark, D.entities(spark, sf).drop("clean_text"), scratch(spark, "entities"))
    again = rows.where("doc_id % 5 = 0").withColumn("primary_industry", F.lit("Finance"))
    n, e = G.merge_graph(*G.build_graph(rows, "doc_id"), *G.build_graph(again, "doc_id"))
    by_edge = e.groupBy(F.col("rel").alias("name"), F.col("dst").alias("detail")).agg(F.count("*").alias("n"))
    by_node = n.groupBy(F.col("label").alias("name"), F.coalesce("industry", F.lit("")).alias("detail")).agg(F.count("*").alias("n"))
    return by_edge.withColumn("part", F.lit("edge")).unionByName(by_node.withColumn("part", F.lit("node")))


@query("graph_counters", _G + """SELECT count(*) AS articles_added,
  cast(sum(len(cve_ids) + len(ip_addresses) + len(malware_names) + len(threat_actors)) AS bigint) AS entity_mentions,
  cast(sum(len(threat_actors) * len(malware_names) + len(malware_names) * len(cve_ids) + len(threat_actors)
      + len(threat_actors) * len(ip_addresses)) AS bigint) AS relations_attempted FROM ga""")
def _(spark, sf):
    return G.graph_counters(D.entities(spark, sf))


@query("graph_summary", _G + """SELECT 'node' AS part, label AS name, count(*) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'node', '(total)', count(*) FROM nodes UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel
UNION ALL SELECT 'edge', '(total)', count(*) FROM edges""")
def _(spark, sf):
    return G.graph_summary(*_graph(spark, sf))


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    # Nodes and edges both read the entity rows, so the text work is done and written once.
    return G.build_graph(stage(spark, D.entities(spark, sf).drop("clean_text"), scratch(spark, "entities")), "doc_id")


# == Query surface ==========================================================

_LISTING = """,
art AS (SELECT key, title, industry FROM nodes WHERE label = 'Article'),
pick AS (SELECT e.*, art.title, art.industry FROM edges e LEFT JOIN art ON e.src_label = 'Article' AND e.src = art.key)
SELECT CASE WHEN src_label = 'Article' THEN coalesce(nullif(left(title, 40), ''), 'Unknown') ELSE src END AS source,
       src_label AS source_type, dst AS target, dst_label AS target_type, rel AS relationship
FROM pick {where} ORDER BY src_label, src, rel, dst_label, dst LIMIT 100"""


@query("graph_listing", _G + _LISTING.format(where=""))
def _(spark, sf):
    return A.graph_listing(*_graph(spark, sf))


@query("graph_listing_industry", _G + _LISTING.format(
    where="WHERE (src_label = 'Industry' AND src = 'ICS') OR (dst_label = 'Industry' AND dst = 'ICS') OR industry = 'ICS'"))
def _(spark, sf):
    return A.graph_listing(*_graph(spark, sf), industry="ICS")


_NAMES = ("doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('n', lang) ELSE '' END AS name",
          "CASE WHEN doc_id % 3 = 0 THEN concat('i', lang) END AS id2",
          "CASE WHEN doc_id % 5 = 0 THEN source END AS address",
          "CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(source, ' a title of well over forty characters in all') END AS title")


@query("display_name", f"""WITH n AS (SELECT {', '.join(_NAMES)} FROM documents)
SELECT doc_id, coalesce(nullif(name, ''), nullif(id2, ''), nullif(address, ''), nullif(left(title, 40), ''), 'Unknown') AS shown FROM n""")
def _(spark, sf):
    rows = D.documents(spark, sf).selectExpr(*_NAMES)
    return rows.select("doc_id", A.display_name(*map(F.col, ("name", "id2", "address", "title"))).alias("shown"))


@query("stats", _G + """SELECT (SELECT count(*) FROM embeddings) AS total_articles,
  (SELECT count(*) FROM nodes WHERE label = 'Industry') AS industries_covered,
  (SELECT max(len(embedding)) FROM embeddings) AS embedding_dimensions,
  (SELECT count(*) FROM nodes) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_relationships""")
def _(spark, sf):
    out = A.stats(spark.read.parquet(f"{sf}/embeddings.parquet"), *_graph(spark, sf))
    return out.withColumn("embedding_dimensions", long("embedding_dimensions"))


_TOP = """SELECT dst_label AS kind, dst AS name, count(*) AS connections FROM edges
WHERE rel = 'MENTIONS' AND dst_label <> 'IPAddress' {where} GROUP BY dst_label, dst
QUALIFY row_number() OVER (PARTITION BY dst_label ORDER BY count(*) DESC, dst) <= 10"""


@query("top_entities", _G + _TOP.format(where=""))
def _(spark, sf):
    return A.top_entities(*_graph(spark, sf))


@query("top_entities_industry", _G + _TOP.format(
    where="AND src IN (SELECT key FROM nodes WHERE label = 'Article' AND industry = 'Finance')"))
def _(spark, sf):
    return A.top_entities(*_graph(spark, sf), industry="Finance")


@query("industry_stats", _G + "SELECT dst AS industry, count(*) AS count FROM edges WHERE rel = 'TARGETS' "
       "AND src_label = 'Article' GROUP BY dst")
def _(spark, sf):
    return A.industry_stats(G.graph_edges(D.entities(spark, sf)))


_ALERTS = """SELECT title, url, primary_industry, coalesce(try_cast(threat_score AS double), 0.0) AS threat_score,
  cast(least(10, (SELECT count(*) FROM col {where})) AS bigint) AS count FROM {src} {where} ORDER BY 4 DESC, url LIMIT 10"""


@query("alerts", f"WITH {D.COLLECTION_CTES} " + _ALERTS.format(src="col", where=""))
def _(spark, sf):
    return A.alerts(D.collection(spark, sf))


@query("alerts_industry", f"WITH {D.COLLECTION_CTES} " + _ALERTS.format(src="col", where="WHERE primary_industry = 'IoT'"))
def _(spark, sf):
    return A.alerts(D.collection(spark, sf), industry="IoT")


# == Increments =============================================================


@query("new_articles", D.with_articles("SELECT url FROM a WHERE doc_id % 4 <> 0"))
def _(spark, sf):
    rows = D.articles(spark, sf)
    twice = rows.unionByName(rows.where("doc_id % 6 = 1"))
    return I.new_articles(twice, rows.where("doc_id % 4 = 0").select("url")).select("url")


@query("advance_ledger", D.with_articles("SELECT url FROM a WHERE doc_id % 4 = 0 OR doc_id % 3 = 0"))
def _(spark, sf):
    rows = D.articles(spark, sf)
    return I.advance_ledger(rows.where("doc_id % 4 = 0").select("url"), rows.where("doc_id % 3 = 0"))


@query("drop_seen_pages", "SELECT min(page_id) AS page_id, url FROM pages WHERE url NOT IN "
       "(SELECT url FROM pages WHERE page_id % 10 = 0) GROUP BY url")
def _(spark, sf):
    rows = D.read_table(spark, sf, "pages", "page_id")
    fresh = P.drop_seen(rows, rows.where("page_id % 10 = 0"), F.col("page_id").asc())
    return fresh.select("page_id", "url")


def _plain_tagger(df):
    """Keeps all articles but those whose title ends in a seven; something SQL can say as well."""
    kept = df.where(~F.col("title").endswith("7"))
    return kept.withColumns({"threat_score": F.lit(0.9), "primary_industry": F.lit("Finance"), "industry_score": F.lit(0.8)})


@query("incremental_runs", f"""WITH {D.CLEAN_CTES},
kept AS (SELECT length(url) % 2 = 0 AS earlier FROM clean WHERE {D.sql_words('clean_text')} >= 100 AND title NOT LIKE '%7')
SELECT 1 AS increment, (SELECT count(*) FROM clean WHERE length(url) % 2 = 1) AS new_articles, count(*) FILTER (NOT earlier) AS threat_relevant,
       count(*) FILTER (NOT earlier) AS embedded, count(*) AS vectors_total FROM kept""")
def _(spark, sf):
    """Two increments over halves of the articles; the summary of the second."""
    from intelweave.plans.batch import Layout, Models, cleaned

    raw = stage(spark, D.articles(spark, sf).select("id", "title", "url", "content"), scratch(spark, "articles"))  # the fit and both increments read it
    models = Models(None, None, None, V.fit_embedder(cleaned(raw)), tagger=_plain_tagger)
    layout = Layout(scratch(spark, "increments"))
    I.run_increment(spark, raw.where("length(url) % 2 = 0"), models, layout, 0)
    done = I.run_increment(spark, raw, models, layout, 1)
    return done.select(*[long(c).alias(c) for c in done.columns])


@query("ledger_buckets", D.with_articles("""SELECT url, 'new' AS part FROM a WHERE doc_id % 4 = 0
UNION ALL SELECT url, 'kept' FROM a WHERE doc_id % 4 <> 0 AND doc_id % 40 = 1"""))
def _(spark, sf):
    """A ledger in three increments, asked for some of its URLs and some others: what is new, and what of the asked it holds."""
    rows = stage(spark, D.articles(spark, sf).select("doc_id", "title", "url"), scratch(spark, "articles"))
    path = scratch(spark, "ledger")
    for n in (stores.BASE, 0, 1):
        stores.write_ledger(rows.where(F.col("doc_id") % 4 == n + 2), path, n)
    asked = rows.where("doc_id % 4 = 0 OR doc_id % 40 = 1")
    ledger = stores.read_ledger(spark, path, near=asked)
    new = I.new_articles(asked, ledger).select("url", F.lit("new").alias("part"))
    return new.unionByName(ledger.join(asked, "url", "left_semi").select("url", F.lit("kept").alias("part")))


@query("build_then_increment", f"""WITH {D.CLEAN_CTES},
sized AS (SELECT doc_id, url, clean_text, {D.sql_words('clean_text')} AS n FROM clean)
SELECT url, -1 AS increment FROM sized WHERE doc_id % 2 = 0 AND n > 100 QUALIFY row_number() OVER (PARTITION BY clean_text ORDER BY url) = 1
UNION ALL SELECT url, 0 FROM sized WHERE doc_id % 2 = 1 AND n >= 100""")
def _(spark, sf):
    """A full build of half the articles, then an increment over all of them: the rows of the entity table."""
    from intelweave.plans import batch

    def tagger(df):
        return df.withColumns({"threat_score": F.lit(0.9), "primary_industry": F.lit("Finance"), "industry_score": F.lit(0.8)})

    raw = stage(spark, D.articles(spark, sf).select("doc_id", "id", "title", "url", "content"), scratch(spark, "articles"))  # the fit, the build and the increment read it
    models = batch.Models(None, None, None, V.fit_embedder(batch.cleaned(raw)), tagger=tagger)
    layout = batch.Layout(scratch(spark, "build"))
    batch.build(spark, raw.where("doc_id % 2 = 0").drop("doc_id", "id"), models, layout)
    I.run_increment(spark, raw.drop("doc_id"), models, layout, 0)
    return spark.read.parquet(layout.at("entities")).select("url", long("increment").alias("increment"))


@query("kept_counts", _G + """,
moved AS (SELECT url, threat_actors FROM ga WHERE doc_id % 5 = 0),
e AS (SELECT * FROM edges UNION SELECT 'Article', url, 'TARGETS', 'Industry', 'Moved' FROM moved
      UNION SELECT 'ThreatActor', unnest(threat_actors), 'TARGETS', 'Industry', 'Moved' FROM moved),
n AS (SELECT label, key, CASE WHEN label = 'Article' AND key IN (SELECT url FROM moved) THEN 'Moved' ELSE industry END AS industry FROM nodes
      UNION ALL SELECT 'Industry', 'Moved', NULL WHERE EXISTS (SELECT 1 FROM moved))
SELECT 'node' AS measure, label AS kind, '' AS name, '' AS industry, count(*) AS n FROM n GROUP BY label
UNION ALL SELECT 'edge', rel, '', '', count(*) FROM e GROUP BY rel
UNION ALL SELECT 'article', 'Article', '', industry, count(*) FROM n WHERE label = 'Article' GROUP BY industry
UNION ALL SELECT 'mention', dst_label, dst, n.industry, count(*) FROM e JOIN n ON label = 'Article' AND key = src
          WHERE src_label = 'Article' AND rel = 'MENTIONS' GROUP BY dst_label, dst, n.industry
UNION ALL SELECT 'target', 'Industry', dst, '', count(*) FROM e WHERE src_label = 'Article' AND rel = 'TARGETS' GROUP BY dst""")
def _(spark, sf):
    """Counts kept over a build and three increments, the last of which moves a fifth of the articles to another industry."""
    rows = stage(spark, D.entities(spark, sf).drop("clean_text"), scratch(spark, "entities"))
    parts = [rows.where(F.col("doc_id") % 3 == n) for n in range(3)]
    path = scratch(spark, "counted")
    for n, part in enumerate([*parts, rows.where("doc_id % 5 = 0").withColumn("primary_industry", F.lit("Moved"))], stores.BASE):
        stores.write_graph(*G.build_graph(part, "doc_id"), f"{path}/graph", clear_first=n == stores.BASE, increment=n)
        stores.write_counts(spark, f"{path}/graph", f"{path}/counts", n)
    return stores.read_counts(spark, f"{path}/counts")


# == Sources and sinks ======================================================


@query("articles_jsonl", D.with_articles("SELECT id, title, url, content FROM a"))
def _(spark, sf):
    path = scratch(spark, "articles")
    rows = D.articles(spark, sf).select("doc_id", "id", "title", "url", "content")
    tables.append_articles(rows.where("doc_id % 2 = 0").drop("doc_id"), path)
    tables.append_articles(rows.where("doc_id % 2 = 1").drop("doc_id"), path)
    return tables.read_articles(spark, path)[0].select("id", "title", "url", "content")


@query("articles_bad_lines", "SELECT cast(count(*) AS bigint) AS bad_count FROM documents WHERE doc_id % 10 = 3")
def _(spark, sf):
    path = scratch(spark, "articles")
    lines = D.articles(spark, sf).select(
        F.when(F.col("doc_id") % 10 == 3, F.lit('{"title": "cut o')).otherwise(F.to_json(F.struct("id", "title", "url"))))
    lines.write.text(path)
    return tables.read_articles(spark, path)[1]


@query("stage_csv_roundtrip", f"WITH {D.ENTITY_CTES} SELECT title, url, clean_text, {D.sql_join('cve_ids')} AS cve_ids, "
       f"{D.sql_join('malware_names')} AS malware_names FROM ent WHERE clean_text <> ''")
def _(spark, sf):
    rows = D.entities(spark, sf).select("title", "url", "clean_text", "cve_ids", "malware_names")
    path = scratch(spark, "stage")
    tables.write_stage(rows.where("clean_text <> ''"), path, "csv")
    back = tables.read_stage(spark, path, "csv", rows.schema)
    return back.withColumns({c: X.join_list(c) for c in ("cve_ids", "malware_names")})


@query("stage_parquet_roundtrip", f"WITH {D.CLEAN_CTES} SELECT doc_id, title, clean_text FROM clean")
def _(spark, sf):
    path = scratch(spark, "stage")
    tables.write_stage(D.cleaned(spark, sf).select("doc_id", "title", "clean_text"), path)
    return tables.read_stage(spark, path)


@query("ledger_roundtrip", D.with_articles("SELECT url FROM a"))
def _(spark, sf):
    path = scratch(spark, "ledger")
    rows = D.articles(spark, sf)
    tables.append_ledger(rows.where("doc_id % 2 = 0").select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("url")), path)
    tables.append_ledger(rows.where("doc_id % 3 = 0 OR doc_id % 2 = 1").unionByName(
        rows.where("doc_id % 50 = 0").withColumn("url", F.lit("  "))), path)
    return tables.read_ledger(spark, path)


@query("label_map_roundtrip", D.with_articles(
    "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT primary_industry AS label FROM a)"))
def _(spark, sf):
    path = scratch(spark, "labels")
    tables.save_label_map(C.label_map(D.articles(spark, sf), "primary_industry"), path)
    return tables.load_label_map(spark, path).select("label", long("label_id").alias("label_id"))


@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(spark, sf):
    rows = tables.read_pages(spark, f"{sf}/pages.parquet")
    return rows.select("page_id", "url", long(F.length("html")).alias("chars"))


@query("read_negatives", "SELECT text FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    return tables.read_negatives(D.read_table(spark, sf, "conversations", "conv_id"))
