"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's
rate is shrunk towards the level above by a beta-binomial prior whose strength is estimated, by the
method of moments, from how much the groups of that level differ beyond chance. A host is blocked
where the lower bound of its posterior bad rate lies above ``max_bad``: few labels never block a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.llm.common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
#: Bounds of the share of variance between groups; strength is its inverse less one.
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffix(host: Column, two_part: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*two_part), pair).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, two_part: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*two_part), F.substring_index(host, ".", -3)).otherwise(pair)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; of equal length, the first in alphabetical order."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Pseudo-counts of the prior of groups with ``n``, ``bad`` and their parent's rate ``prior``."""
    p = F.col("prior")
    chance = F.col("n") * p * (1 - p)
    r = groups.agg(F.sum((F.col("bad") - F.col("n") * p) * (F.col("bad") - F.col("n") * p)).alias("seen"), F.sum(chance).alias("chance"),
                   F.sum(chance * (F.col("n") - 1)).alias("weight")).first()
    spread = (r["seen"] - r["chance"]) / r["weight"] if r["weight"] else 0.0
    return 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645, two_part: tuple[str, ...] = TWO_PART_SUFFIXES) -> DataFrame:
    """host, n, bad, rate, low, high: posterior mean of the bad rate and its bounds, from (host, bad 0/1) rows.

    Counts are added up before any shuffle; what follows has a row per host at most. One host, domain or
    suffix may hold most rows. Null outcomes and hosts are left out; no outcomes give no rows.
    """
    hosts = outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    # Written once, a row per host: the levels above and their priors are read from there, not from the outcomes again.
    hosts = staged(hosts.withColumns({"domain": registered_domain(F.col("host"), two_part), "suffix": host_suffix(F.col("host"), two_part)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    prior = F.lit((total["bad"] + 1) / (total["n"] + 2))

    def shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
        s = _strength(groups)
        return groups.withColumn("rate", (F.col("bad") + F.col("prior") * s) / (F.col("n") + s)), s

    suffixes, _ = shrunk(suffixes.withColumn("prior", prior))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"))
    hosts, s = shrunk(hosts.join(domains.select("domain", F.col("rate").alias("prior")), "domain"))
    half = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + s + 1)) * z
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    max_bad: float = 0.5,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, the rule that fits (else null), verdict ``allow`` or ``block``.

    ``outcomes`` has (id, bad): 1 for a page judged bad, 0 for a good one; several rows of an id all
    count. Without a rule the host's posterior decides; hosts without outcomes are allowed. A null url,
    or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated pages and
    null ids stay as they are; other columns are left out, so their names cannot clash.
    """
    rows = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = rows.filter(F.col("host") != "").join(outcomes.select(F.col(id_col).alias("id"), "bad"), "id").select("host", "bad")
    blocked = host_reputation(judged, z).filter(F.col("low") > max_bad).select("host", F.lit(True).alias("blocked"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.join(blocked, "host", "left").select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


