"""Classification: model input, label scoring, training tables, models and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.flow import with_computed
from intelweave.functions.text import strip_ws
from intelweave.operators.quality import min_words
from intelweave.operators.sampling import sample_exact
from intelweave.session import cut_lineage

_SCORES = "array<struct<label:string,score:double>>"


def model_input(title: Column | None = None, text: Column | None = None) -> Column:
    """``"{title}. {first 300 characters of the cleaned text}"``, both trimmed."""
    title = F.col("title") if title is None else title
    text = F.col("clean_text") if text is None else text
    blank = F.lit("")
    return F.concat(
        strip_ws(F.coalesce(title, blank)),
        F.lit(". "),
        F.substring(strip_ws(F.coalesce(text, blank)), 1, 300),
    )


# -- label scoring without training -----------------------------------------


def score_labels(
    text: Column, labels: Sequence[str], multi_label: bool, sharpness: float = 8.0, offset: float = 0.1
) -> Column:
    """Score label descriptions for a text by word overlap, best first.

    Similarity is the cosine of the two word sets. Single-label scores pass
    through a softmax and sum to one; multi-label scores are independent
    logistic values. :func:`score_with` takes a trained scorer instead.
    """
    def words(c: Column) -> Column:
        parts = F.split(F.lower(c), r"[^a-z0-9]+")
        return F.array_distinct(F.filter(parts, lambda w: w != ""))

    def scores(have: Column) -> Column:
        def cosine(label: str) -> Column:
            want = sorted({w for w in _words(label)})
            both = F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in want])))
            size = F.greatest(F.size(have), F.lit(1)).cast("double")
            return both / F.sqrt(size * F.lit(float(len(want))))

        sims = [cosine(label) for label in labels]
        if multi_label:
            raw = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-sharpness) * (s - F.lit(offset)))) for s in sims]
            total = F.lit(1.0)
        else:
            raw = [F.exp(F.lit(sharpness) * s) for s in sims]
            total = sum(raw[1:], raw[0])
        return F.array(
            *[F.struct(F.lit(x).alias("label"), (r / total).alias("score")) for x, r in zip(labels, raw)]
        )

    position = {label: i for i, label in enumerate(labels)}
    order = F.create_map(*[F.lit(v) for pair in position.items() for v in pair])
    found = F.element_at(F.transform(F.array(words(text)), scores), 1)
    # Descending score, ties in the order the labels were given.
    keyed = F.transform(found, lambda s: F.struct((-s["score"]).alias("k"), order[s["label"]].alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda s: s["s"]).cast(_SCORES)


def _words(label: str) -> list[str]:
    out = "".join(ch if ch.isalnum() else " " for ch in label.lower())
    return out.split()


def score_with(
    df: DataFrame,
    column: str,
    out: str,
    scorer: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]],
) -> DataFrame:
    """Score texts with a user model, one Arrow batch at a time.

    ``scorer`` runs once per task and returns the function from texts to
    ``(label, score)`` lists.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` {_SCORES}"

    def run(batches):
        score = scorer()
        for pdf in batches:
            ranked = [sorted(s, key=lambda p: -p[1]) for s in score(pdf[column].tolist())]
            yield pdf.assign(**{out: [[{"label": n, "score": float(v)} for n, v in s] for s in ranked]})

    return df.mapInPandas(run, schema)


def pick_labels(scored: DataFrame, binary: str = "binary", industry: str = "industry") -> DataFrame:
    """Apply the thresholds to ranked scores.

    Rows whose top label is the unrelated one or scores under 0.55 are dropped;
    the second industry is named only over 0.40.
    """
    top, first, second = (F.get(F.col(c), F.lit(i)) for c, i in ((binary, 0), (industry, 0), (industry, 1)))
    kept = scored.where(
        ~F.contains(top["label"], F.lit(vocab.UNRELATED_MARK)) & (top["score"] >= vocab.THREAT_THRESHOLD)
    )
    return kept.withColumns(
        {
            "threat_score": F.round(top["score"], 4),
            "primary_industry": first["label"],
            "industry_score": F.round(first["score"], 4),
            "secondary_industry": F.when(
                second["score"] > vocab.SECONDARY_THRESHOLD, second["label"]
            ).otherwise(""),
        }
    ).drop(binary, industry)


def bootstrap_tags(
    df: DataFrame,
    threat_label: str = vocab.THREAT_LABEL,
    unrelated_label: str = vocab.UNRELATED_LABEL,
    industries: Sequence[str] = tuple(vocab.INDUSTRIES),
) -> DataFrame:
    """Tag articles with no trained model: score, then pick."""
    text = model_input()
    scored = with_computed(df, {"binary": score_labels(text, [threat_label, unrelated_label], False)})
    kept = scored.where(F.get("binary", F.lit(0))["label"] == threat_label)
    return pick_labels(with_computed(kept, {"industry": score_labels(text, list(industries), True)}))


# -- training tables --------------------------------------------------------


def balanced_training_set(positives: DataFrame, negatives: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``(key, text, label)``: all long enough positives and as many negatives, in hash order free of partitioning.

    ``key`` must be unique within each side.
    """
    pos = min_words(positives.where("text is not null"), vocab.TRAINING_MIN_WORDS, column="text")
    n = pos.agg(F.count("*").alias("n")).scalar()
    neg = sample_exact(negatives.where("text is not null"), n, [key], seed)
    return pos.select(key, "text", F.lit(1).alias("label")).unionByName(
        neg.select(key, "text", F.lit(0).alias("label"))
    )


def label_map(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels in ascending order numbered from 0: ``(label_id, label)``.

    The ranking runs over the class list in one task: a column with very many
    values is no class column. Give it the narrow source, not a frame that
    computes texts.
    """
    labels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    ids = F.dense_rank().over(Window.orderBy("label")) - 1
    return labels.select(ids.alias("label_id"), "label")


def encode_labels(df: DataFrame, column: str, mapping: DataFrame | None = None) -> DataFrame:
    """Add ``label_id``; rows with an unknown or null label are dropped."""
    mapping = label_map(df, column) if mapping is None else mapping
    ids = mapping.select("label_id", F.col("label").alias(column))
    return df.join(ids, column)


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # One scan: the window runs over the counted classes, of which a model has few.
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def with_weights(df: DataFrame, column: str) -> DataFrame:
    weights = class_weights(df, column).select(column, "weight")
    return df.join(weights, column)


# -- models -----------------------------------------------------------------


def _text_classifier(text: str, label: str, features: int, iterations: int, weight: str | None) -> Pipeline:
    lr = LogisticRegression(
        featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01,
        family="binomial" if weight is None else "multinomial",
        **({} if weight is None else {"weightCol": weight}),
    )
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\s+"),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            lr,
        ]
    )


def train_binary(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14,
                 iterations: int = 20) -> PipelineModel:
    """Threat / no threat classifier on ``(text, label)``; the rows are computed once and staged."""
    return _text_classifier(text, label, features, iterations, None).fit(cut_lineage(df.select(text, label)))


def train_industry(df: DataFrame, text: str = "text", label: str = "label_id", features: int = 1 << 14,
                   iterations: int = 20) -> PipelineModel:
    """Multi-class classifier whose loss carries balanced class weights."""
    return _text_classifier(text, label, features, iterations, "weight").fit(with_weights(cut_lineage(df.select(text, label)), label))


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` (class id) and ``confidence`` (its probability)."""
    out = model.transform(df)
    return out.select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediction"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def tag_articles(
    df: DataFrame, binary: PipelineModel, industry: PipelineModel, mapping: DataFrame
) -> DataFrame:
    """Cascade: keep class 1 of the binary model, then name the industry.

    ``mapping`` is the ``(label_id, label)`` table of the industry model. Both
    models read column ``text``, the model input built here.
    """
    inputs = df.withColumn("text", model_input())
    threats = (
        predict(inputs, binary)
        .where("prediction = 1")
        .withColumn("threat_score", F.round("confidence", 4))
        .drop("prediction", "confidence")
    )
    named = predict(threats, industry).withColumn("industry_score", F.round("confidence", 4))
    ids = mapping.select(F.col("label_id").alias("prediction"), F.col("label").alias("primary_industry"))
    return named.join(ids, "prediction").drop("prediction", "confidence", "text")


def evaluate(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and weighted F1, from the confusion counts alone."""
    confusion = pred.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    # Each cell counts once for its true class and once for its predicted class.
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("l").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                         F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    f1 = F.lit(2.0) * F.col("hit") / (F.col("support") + F.col("said"))
    total = F.sum("support")
    return per_class.agg(
        F.round(F.sum("hit") / total, 6).alias("accuracy"),
        F.round(F.sum(f1 * F.col("support")) / total, 6).alias("weighted_f1"),
    )
