"""Entity extraction over cleaned articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions import entities as E
from intelweave.functions import text as X
from intelweave.functions.bitmap import asked_in_subquery
from intelweave.functions.flow import bind, with_computed

KINDS = ["cve_ids", "ip_addresses", "malware_names", "threat_actors"]


def with_words(df: DataFrame, column: str) -> DataFrame:
    """Add ``_lowered`` and its word runs ``_words`` for gazetteer matching."""
    lowered = with_computed(df, {"_lowered": F.lower(F.coalesce(F.col(column), F.lit("")))})
    return with_computed(lowered, {"_words": F.split("_lowered", E.NOT_WORD_RUN)})


def extract_entities(
    df: DataFrame,
    column: str = "clean_text",
    malware: list[str] | None = None,
    actors: list[str] | None = None,
    ambiguous: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add the sorted arrays ``cve_ids, ip_addresses, malware_names, threat_actors``.

    ``ambiguous`` maps a term to the phrases of which one must stand near it. Null or blank text gives four empty arrays.
    """
    malware = vocab.MALWARE_TERMS if malware is None else malware
    actors = vocab.ACTOR_TERMS if actors is None else actors
    low, words, text = F.col("_lowered"), F.col("_words"), F.coalesce(F.col(column), F.lit(""))
    names = bind(
        E.match_terms(low, words, malware), lambda found: E.drop_unsupported(low, found, ambiguous)
    )
    found = {
        "cve_ids": X.extract_cves(text),
        "ip_addresses": X.extract_ips(text),
        "malware_names": F.array_sort(names),
        "threat_actors": F.array_sort(E.match_terms(low, words, actors)),
    }
    return with_computed(with_words(df, column), found).select(*df.columns, *KINDS)


def match_gazetteer(df: DataFrame, key: str, gazetteer: DataFrame, column: str = "clean_text") -> DataFrame:
    """``(key, kind, terms)`` against a gazetteer *table* ``(kind, term)`` of any size; case does not matter.

    Word and separator runs alternate in a text, so a term is a slice of a fixed number of runs. Two bitmaps,
    sized from the table, stand in front of the exact join: a run is looked up among the first runs of terms,
    and only where one may begin slices are formed and looked up among whole terms. Nearly all other slices
    are never made, whatever the table's size. The table is read a few times: stage one that is costly.
    Both are asked row by row, as subqueries: no plan holds their bits.
    """
    runs = f"{E.WORD_RUN}|{E.NOT_WORD_RUN}"
    terms = gazetteer.select("kind", F.lower("term").alias("term")).distinct()
    cut = terms.select("term", F.regexp_extract_all("term", F.lit(runs), F.lit(0)).alias("p"))
    shaped = cut.where(F.size("p") > 0).select(
        F.xxhash64(F.get("p", F.lit(0))).alias("first"),
        F.col("term").rlike(f"^{E.WORD_RUN}").alias("starts"),
        F.size("p").alias("n"),
    )
    # A handful of shapes, however many terms there are.
    shapes = sorted((r["n"], r["starts"]) for r in shaped.select("starts", "n").distinct().collect())
    if not shapes:
        return df.limit(0).select(key, F.lit("").alias("kind"), F.array().cast("array<string>").alias("terms"))
    known = asked_in_subquery(gazetteer.select(F.xxhash64(F.lower("term")).alias("h")), "h")
    # Terms of one run are their own first run: they need no second look.
    longer = [(n, starts) for n, starts in shapes if n > 1]

    # Runs alternate: whether the first one is a word tells it of all.
    is_word = lambda begins, i: (i % 2 == 0) == begins
    cut_up = lambda body: bind(F.col("_p"), lambda p: bind(F.get(p, F.lit(0)).rlike(f"^{E.WORD_RUN}"), lambda begins: body(p, begins)))

    def lone(p: Column, begins: Column) -> Column:
        # A word boundary needs a word run on one side: an outer separator counts only with another run beyond it.
        signs = lambda i: (i > 0) & (i + 1 < F.size(p)) if (1, False) in shapes else F.lit(False)
        return F.array_distinct(F.filter(p, lambda w, i: is_word(begins, i) | signs(i)))

    def places(p: Column, begins: Column) -> Column:
        # Each run that may open a term, with as many behind it as the longest term may need, and one more for its boundary.
        least, most, starts = min(longer)[0], max(longer)[0], {s for _, s in longer}
        opens = lambda i: (i + least <= F.size(p)) & (F.lit(True) if len(starts) == 2 else is_word(begins, i) == F.lit(True in starts))
        at = lambda w, i: F.struct(w.alias("w"), (i > 0).alias("inner"), F.slice(p, i + 2, F.lit(most)).alias("rest"))
        opening = F.array_compact(F.transform(p, lambda w, i: F.when(opens(i), at(w, i))))
        if shapes[0][0] > 1:
            return opening
        whole = F.lit(None).cast("array<string>").alias("rest")
        return F.concat(F.transform(lone(p, begins), lambda w: F.struct(w.alias("w"), F.lit(False).alias("inner"), whole)), opening)

    def gram(n: int, starts: bool) -> Column:
        opens = F.col("w").rlike(f"^{E.WORD_RUN}") == F.lit(starts)
        before = F.lit(True) if starts else F.col("inner")
        ends_with_word = starts == (n % 2 == 1)
        after = F.size("rest") >= (n - 1 if ends_with_word else n)
        return F.when(opens & before & after, F.concat("w", F.array_join(F.slice("rest", 1, n - 1), "")))

    may_be = lambda column: known(F.xxhash64(column))
    if shapes == [(1, True)]:
        # Single words all of them: the different words of a text are looked up once each, and no separator is.
        words = F.filter(F.array_distinct(F.split(F.lower(column), E.NOT_WORD_RUN)), lambda w: w != "")
        grams = df.select(key, F.explode(words).alias("term")).where(may_be("term"))
    else:
        pieces = df.select(key, F.regexp_extract_all(F.lower(column), F.lit(runs), F.lit(0)).alias("_p"))
        if not longer:
            grams = pieces.select(key, F.explode(cut_up(lone)).alias("term")).where(may_be("term"))
        else:
            first = asked_in_subquery(shaped.where("n > 1").select("first"), "first")
            single = F.col("rest").isNull()
            met = pieces.select(key, F.inline(cut_up(places)))
            met = met.where(F.when(single, may_be("w")).otherwise(first(F.xxhash64("w"))))
            formed = F.when(single, F.array("w")).otherwise(F.array_compact(F.array(*[gram(n, starts) for n, starts in longer])))
            grams = met.select(key, F.explode(formed).alias("term")).where(may_be("term"))
    return grams.join(terms, "term").groupBy(key, "kind").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def combine(df: DataFrame, model_malware: str | None = None, model_actors: str | None = None) -> DataFrame:
    """Merge model entities (array columns, if any) into the keyword columns, vendors removed."""
    pick = lambda name: None if name is None else F.col(name)
    return df.withColumns(
        {
            "malware_names": E.combine_entities(F.col("malware_names"), pick(model_malware)),
            "threat_actors": E.combine_entities(F.col("threat_actors"), pick(model_actors)),
        }
    )


def entity_totals(df: DataFrame) -> DataFrame:
    """``(kind, total, articles)`` per entity kind plus an ``any`` row, in one pass."""
    sizes = {k: F.coalesce(F.size(k), F.lit(0)) for k in KINDS}
    any_size = sum(sizes.values(), F.lit(0))
    aggs = []
    for k, s in {**sizes, "any": any_size}.items():
        aggs += [F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"t_{k}"), F.count(F.when(s > 0, 1)).alias(f"a_{k}")]
    rows = [
        F.struct(F.lit(k).alias("kind"), F.col(f"t_{k}").alias("total"), F.col(f"a_{k}").alias("articles"))
        for k in [*KINDS, "any"]
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
