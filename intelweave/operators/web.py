"""Article, advisory and link extraction from a table of fetched pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions import html as H
from intelweave.functions import text as X
from intelweave.functions import urls as U
from intelweave.functions.flow import with_computed
from intelweave.operators.quality import first_per, not_stored


def html_only(pages: DataFrame) -> DataFrame:
    """Keep pages served as HTML; a table without ``content_type`` passes whole."""
    if "content_type" not in pages.columns:
        return pages
    return pages.where(F.contains(F.lower("content_type"), F.lit("text/html")))


def routed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("route", U.route(F.col("url")))


def extract_links(pages: DataFrame) -> DataFrame:
    """Every link as ``(page_id, pos, src_url, href, target_url)``; a ``base[href]`` is what relative links start from."""
    read = with_computed(pages.select("page_id", F.col("url").alias("src_url"), "html"), {"links": H.links(F.col("html"))})
    start = F.coalesce(U.resolve_link(F.col("src_url"), F.col("links.base")), F.col("src_url"))
    # What links are resolved against is cut out of the page's address once, not for each of them.
    placed = with_computed(read.select("page_id", "src_url", "links"), {"page": U.page_parts(start)})
    found = placed.select("page_id", "src_url", "page", F.posexplode("links.hrefs").alias("pos", "href"))
    return with_computed(found, {"target_url": U.resolve(F.col("page"), F.col("href"))}).drop("page")


def advisory_links(links: DataFrame) -> DataFrame:
    """Links of advisory-site pages with ``link_class`` ``advisory`` or ``index``.

    A link that is both counts as ``advisory``: that class is followed first.
    """
    href = F.col("href")
    cls = F.when(U.contains_any(href, vocab.ADVISORY_LINK_MARKS), "advisory").when(
        U.contains_any(href, vocab.INDEX_LINK_MARKS), "index"
    )
    return links.withColumn("link_class", cls).where("link_class is not null")


def frontier(links: DataFrame, seen: DataFrame, match: str | None = "suffix") -> DataFrame:
    """Admissible targets not seen before, each with its first referrer.

    ``match=None`` leaves the admissibility test out, as for advisory and index links.

    Repeats go first (each map task keeps one row per target), so a link every
    page carries reaches the anti-join as a single row.
    """
    ok = links if match is None else links.where(U.is_article_url(F.col("target_url"), match))
    once = first_per(ok, ["target_url"], F.col("page_id").asc(), F.col("pos").asc())
    return once.join(seen.select(F.col("url").alias("target_url")), "target_url", "left_anti")


def drop_seen(df: DataFrame, seen: DataFrame, *order: Column, key: str = "url") -> DataFrame:
    """First row per ``key`` whose key is not blank and not in ``seen``; the ledger is asked before rows are ordered."""
    return first_per(not_stored(df, seen, key), [key], *order)


def _parsed(
    pages: DataFrame, title: Callable[[Column], Column], opening: str, min_node: int, min_content: int
) -> DataFrame:
    # Pages without a usable title never reach the costlier text-node step.
    html = F.col("html")
    titled = with_computed(pages, {"title": title(html)}).where(F.length("title") >= 5)
    content = F.array_join(H.text_nodes(html, opening, min_node), " ")
    return with_computed(titled, {"content": content}).where(F.length("content") >= min_content)


def extract_articles(pages: DataFrame) -> DataFrame:
    """Generic pages to ``(page_id, id, title, url, content)``.

    Content is the paragraphs' text nodes over 40 characters; needs a title of
    five and content of 200 characters.
    """
    kept = _parsed(html_only(pages), H.article_title, "p", 40, min_content=200)
    return kept.select("page_id", X.url_id("url").alias("id"), "title", "url", "content")


def advisory_id(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, vocab.ADVISORY_ID_PATTERN, 1))


def severity(c: Column) -> Column:
    """Severity word of the text when it is a known level, else ``UNKNOWN``."""
    word = F.upper(F.regexp_extract(c, vocab.SEVERITY_PATTERN, 1))
    return F.when(word.isin(vocab.SEVERITIES), word).otherwise("UNKNOWN")


def affected(c: Column) -> Column:
    """Software named after ``software affected``, at most 200 characters."""
    return F.substring(X.strip_ws(F.regexp_extract(c, vocab.AFFECTED_PATTERN, 1)), 1, 200)


def advisory_fields(df: DataFrame, column: str = "content") -> DataFrame:
    c = F.col(column)
    return df.withColumns(
        {
            "source": F.lit(vocab.ADVISORY_SOURCE),
            "advisory_id": advisory_id(c),
            "cves": X.extract_cves(c),
            "severity": severity(c),
            "affected": affected(c),
        }
    )


def extract_advisories(pages: DataFrame) -> DataFrame:
    """Advisory pages to articles plus id, CVEs, severity and affected software.

    Content is the text nodes over 15 characters of cells, paragraphs, list
    items and spans; needs a title of five and content of 100 characters.
    """
    kept = _parsed(pages, H.advisory_title, "td|p|li|span", 15, min_content=100)
    return advisory_fields(kept.select("page_id", X.url_id("url").alias("id"), "title", "url", "content"))


def with_crawled_at(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Stamp rows with the UTC ingest time as ISO text."""
    stamp = F.current_timestamp() if at is None else at
    utc = F.to_utc_timestamp(stamp, F.current_timezone())
    return df.withColumn("crawled_at", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
