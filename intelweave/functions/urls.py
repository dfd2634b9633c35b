"""URL predicates and resolution as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.flow import bind
from intelweave.functions.text import strip_ws


def contains_any(c: Column, marks: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(m)) for m in marks])


def route(url: Column) -> Column:
    """``advisory`` for the advisory site, else ``generic``."""
    return F.when(F.contains(url, F.lit(vocab.ADVISORY_HOST)), "advisory").otherwise("generic")


def link_host(url: Column) -> Column:
    """Third ``/`` segment, lower case, every ``www.`` removed; null without one."""
    seg = F.get(F.split(url, "/"), F.lit(2))
    return F.replace(F.lower(seg), F.lit("www."), F.lit(""))


def is_article_url(url: Column, match: str = "suffix") -> Column:
    """Whether a link may be followed.

    ``match='substring'`` rejects a host that contains a blocked domain anywhere
    (so ``t.co`` also rejects ``threatpost.com``); ``'suffix'`` rejects the
    blocked domain and its subdomains only.
    """
    if match not in ("suffix", "substring"):
        raise ValueError(f"match must be 'suffix' or 'substring', not {match!r}")

    def blocked(host: Column) -> Column:
        if match == "substring":
            return contains_any(host, vocab.BLOCKED_DOMAINS)
        return reduce(Column.__or__, [host.endswith("." + d) for d in vocab.BLOCKED_DOMAINS])

    # The dot in front lets a bare domain match its own suffix form.
    host = link_host(url) if match == "substring" else F.concat(F.lit("."), link_host(url))
    skipped = bind(F.lower(url), lambda u: contains_any(u, vocab.SKIP_URL_MARKS))
    return F.coalesce(~bind(host, blocked) & ~skipped, F.lit(False))


def _settle(path: Column) -> Column:
    """Path with its dot segments resolved: ``..`` climbs, at most to the root, ``.`` and empty ones drop out."""
    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part.isin(".", ""), kept).otherwise(F.concat(kept, F.array(part)))

    def joined(kept: Column) -> Column:
        open_end = (F.size(kept) > 0) & path.rlike(r"/\.{0,2}$")
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"//|/\.{1,2}(?:/|$)"), bind(folded, joined)).otherwise(path)


def page_parts(page_url: Column) -> Column:
    """What relative links of a page are resolved against, as one struct: compute it once a page."""
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_replace(page_url, r"(?s)[?#].*$", "")
    # Directory of the page: everything up to the last "/" behind the host.
    path = F.substring(no_query, F.length(origin) + 1, F.length(no_query))
    return F.struct(
        page_url.alias("url"),
        F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1).alias("scheme"),
        origin.alias("origin"),
        no_query.alias("no_query"),
        F.regexp_replace(page_url, r"(?s)#.*$", "").alias("no_fragment"),
        F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")).alias("folder"),
    )


def resolve(page: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page given by its :func:`page_parts`; only the path is tidied, never a query."""
    def of(href: Column) -> Column:
        own_path = F.regexp_extract(href, r"^([^?#]*)", 1)
        rest = F.substring(href, F.length(own_path) + 1, F.length(href))
        climbed = bind(F.when(href.startswith("/"), own_path).otherwise(F.concat(page["folder"], own_path)), _settle)
        return (
            F.when(href == "", page["url"])
            .when(href.startswith("//"), F.concat(page["scheme"], F.lit(":"), href))
            .when(href.startswith("#"), F.concat(page["no_fragment"], href))
            .when(href.startswith("?"), F.concat(page["no_query"], href))
            .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .otherwise(F.concat(page["origin"], climbed, rest))
        )

    return bind(strip_ws(href), of)


def resolve_link(page_url: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on ``page_url``."""
    return bind(page_parts(page_url), lambda page: resolve(page, href))
