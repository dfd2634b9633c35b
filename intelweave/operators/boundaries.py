"""Sentence ends learnt from the texts themselves, without labels.

Counts of words with and without a final period, over all texts and in one aggregate, tell abbreviations from
sentence ends (a log-likelihood ratio weighted by length, inner periods and uses without the period, after Kiss
and Strunk, 2006). Words that follow sentence ends oftener than chance are starters, words that follow a dotted
word oftener than chance are collocations with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.functions.flow import with_computed

# Fixed values of the paper: thresholds and the share of dotted uses expected of an abbreviation.
ABBREVIATION, STARTER, COLLOCATION, DOTTED_SHARE = 0.3, 30.0, 7.88, 0.99
NUMBER = "##"


@dataclass(frozen=True)
class BoundaryModel:
    """``abbreviations(word, with_period, without_period, score)``, ``starters(word)``, ``collocations(word, following)``."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def tokens_of(text: Column) -> Column:
    """Runs of anything but white space; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def _bare(token: Column) -> Column:
    """Without quotes and brackets around it."""
    return F.regexp_replace(token, r"""^["'(\[]+|["')\]]+$""", "")


def is_dotted(token: Column) -> Column:
    """Ends in one period; two or more are an ellipsis."""
    bare = _bare(token)
    return bare.endswith(".") & ~bare.endswith("..")


def word_type(token: Column) -> Column:
    """Lower case, without surrounding marks and a final period; all numbers are one word."""
    word = F.regexp_replace(F.lower(_bare(token)), r"\.$", "")
    return F.when(F.regexp_like(word, F.lit(r"^[-+]?[0-9][0-9.,]*$")), F.lit(NUMBER)).otherwise(word)


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, dotted, following, n)``: every use of a word, with the word behind it where it is dotted.

    The one pass over the texts; all other counts are sums of these. Equal tokens collapse in each map task first,
    so the patterns run once for a token, not once for a use.
    """
    flat = df.select(tokens_of(F.col(text)).alias("t")).select(
        F.explode(F.transform("t", lambda x, i: F.struct(x.alias("token"), F.get("t", i + 1).alias("next")))).alias("u")
    )
    # Only a token with a period may be dotted; behind others the next one does not matter.
    raw = flat.select("u.token", F.when(F.contains(F.col("u.token"), F.lit(".")), F.col("u.next")).alias("next"))
    raw = raw.groupBy("token", "next").agg(F.count("*").alias("n"))
    dotted = is_dotted(F.col("token"))
    uses = raw.select(word_type(F.col("token")).alias("word"), dotted.alias("dotted"), F.when(dotted, word_type(F.col("next"))).alias("following"), "n")
    return uses.groupBy("word", "dotted", "following").agg(F.sum("n").alias("n"))


def word_counts(pairs: DataFrame) -> DataFrame:
    """``(word, with_period, without_period)``."""
    uses = lambda flag: F.coalesce(F.sum(F.when(F.col("dotted") == flag, F.col("n"))), F.lit(0))
    return pairs.groupBy("word").agg(uses(True).alias("with_period"), uses(False).alias("without_period"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    def term(x: Column, q: Column) -> Column:
        return F.when(x > 0, x * F.ln(q)).otherwise(0.0)

    return term(k, p) + term(n - k, 1 - p)


def _dunning(both: Column, left: Column, right: Column, total: Column) -> Column:
    """Log-likelihood ratio that ``right`` words stand behind ``left`` ones ``both`` times; zero if not above chance."""
    p, inside, outside = right / total, both / left, (right - both) / (total - left)
    ratio = 2 * (_log_likelihood(both, left, inside) + _log_likelihood(right - both, total - left, outside)
                 - _log_likelihood(both, left, p) - _log_likelihood(right - both, total - left, p))
    return F.when((total > left) & (inside > p), ratio).otherwise(0.0)


def _scored(words: DataFrame, total: Column, dotted: Column) -> DataFrame:
    c1, c0 = F.col("with_period"), F.col("without_period")
    chance = dotted / total
    ratio = 2 * (_log_likelihood(c1, c1 + c0, F.lit(DOTTED_SHARE)) - _log_likelihood(c1, c1 + c0, chance))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -c0)
    return words.where((c1 > 0) & (letters > 0) & (F.col("word") != NUMBER)).withColumn("score", score)


def learn_boundaries(df: DataFrame, text: str = "text", staged=None) -> BoundaryModel:
    """A model of the texts' own abbreviations, starters and collocations.

    ``staged`` writes a frame and reads it back (a checkpoint by default): the counts serve all three tables.
    Empty input gives empty tables.
    """
    from intelweave.session import cut_lineage

    staged = staged or cut_lineage
    pairs = staged(pair_counts(df, text))
    words = staged(word_counts(pairs))
    total = words.agg(F.sum(F.col("with_period") + F.col("without_period")).alias("v")).scalar()
    dotted = words.agg(F.sum("with_period").alias("v")).scalar()
    found = staged(_scored(words, total, dotted).where(F.col("score") >= ABBREVIATION))

    uses = words.select(F.col("word").alias("following"), (F.col("with_period") + F.col("without_period")).alias("right"))
    followed = pairs.where("dotted AND following IS NOT NULL AND following <> ''")
    short = found.select("word")
    behind = followed.join(short, "word", "left_anti").where(F.col("word") != NUMBER)
    breaks = behind.agg(F.sum("n").alias("v")).scalar()
    starters = behind.groupBy("following").agg(F.sum("n").alias("both")).join(uses, "following")
    starters = starters.where(F.col("following") != NUMBER).where(_dunning(F.col("both"), breaks, F.col("right"), total) >= STARTER)

    tied = followed.join(short.unionByName(short.sparkSession.createDataFrame([(NUMBER,)], "word string")), "word", "left_semi")
    left = words.select("word", F.col("with_period").alias("left"))
    tied = tied.where(F.col("following") != NUMBER).join(left, "word").join(uses, "following")
    tied = tied.where(_dunning(F.col("n"), F.col("left"), F.col("right"), total) >= COLLOCATION)
    starters = staged(starters.select(F.col("following").alias("word")))
    # A word that likes to begin sentences is no collocation of what stands in front.
    tied = tied.join(starters.select(F.col("word").alias("following")), "following", "left_anti")
    return BoundaryModel(found, starters, staged(tied.select("word", "following")))


def sentence_ends(df: DataFrame, model: BoundaryModel, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys..., end)``: places of the tokens that end a sentence, from 0; a text's last token is not listed.

    Only tokens with a final mark leave the text, without the text, and meet the model's tables.
    """
    spots = F.transform("t", lambda x, i: F.struct(i.cast("long").alias("end"), x.alias("token"), F.get("t", i + 1).alias("next")))
    held = lambda t: F.contains(t, F.lit(".")) | F.contains(t, F.lit("?")) | F.contains(t, F.lit("!"))  # noqa: E731  spares most tokens the patterns
    marked = F.filter(spots, lambda u: held(u["token"]) & F.regexp_like(_bare(u["token"]), F.lit("[.?!]$")) & u["next"].isNotNull())
    flat = df.select(*keys, tokens_of(F.col(text)).alias("t")).select(*keys, F.inline(marked))
    first = F.substring(_bare(F.col("next")), 1, 1)
    rows = flat.select(
        *keys, "end", word_type(F.col("token")).alias("word"), word_type(F.col("next")).alias("following"), is_dotted(F.col("token")).alias("dotted"),
        _bare(F.col("token")).endswith(".").alias("period"),
        (first != F.lower(first)).alias("capital"), (first != F.upper(first)).alias("small"),
    )
    rows = rows.join(model.abbreviations.select("word", F.lit(True).alias("short")), "word", "left")
    rows = rows.join(model.starters.select(F.col("word").alias("following"), F.lit(True).alias("starts")), "following", "left")
    rows = rows.join(model.collocations.withColumn("tied", F.lit(True)), ["word", "following"], "left")
    ends = (
        F.when(~F.col("period"), True)  # a question or an exclamation
        .when(~F.col("dotted"), F.col("capital"))  # an ellipsis
        .when(F.col("tied"), False)
        .when(F.col("short"), F.col("capital") & F.coalesce("starts", F.lit(False)))
        .when(F.col("word") == NUMBER, ~F.col("small"))
        .otherwise(True)
    )
    return rows.where(ends).select(*keys, "end")


def split_sentences(df: DataFrame, model: BoundaryModel, keys: list[str], text: str = "text", out: str = "sentences") -> DataFrame:
    """Add the sentences of each text, tokens joined by single spaces; none for null and blank texts.

    ``keys`` must be unique and not null. What is gathered for a text is places in it, never more than its tokens.
    """
    ends = sentence_ends(df, model, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_list("end")).alias("_ends"))
    # Each step behind a generator: a filter on the result, pushed down, would split the text anew for every sentence.
    rows = with_computed(df.join(ends, keys, "left"), {"_tokens": tokens_of(F.col(text))})
    last = F.size("_tokens").cast("long") - 1
    stops = F.concat(F.coalesce("_ends", F.array().cast("array<bigint>")), F.array(last))
    cut = F.transform(F.col("_stops"), lambda e, i: F.array_join(
        F.slice("_tokens", F.when(i > 0, F.get("_stops", i - 1) + 2).otherwise(F.lit(1)).cast("int"),
                (e - F.when(i > 0, F.get("_stops", i - 1)).otherwise(F.lit(-1))).cast("int")), " "))
    rows = with_computed(rows, {"_stops": stops})
    rows = with_computed(rows, {out: F.when(last >= 0, cut).otherwise(F.array().cast("array<string>"))})
    return rows.select(*df.columns, out)
