"""Toxicity by a classifier chain over label categories.

Categories are predicted in order. Each is a logistic model over word presence; from the second on
it also sees the probabilities of the earlier categories. Those come out of fold in training, so a
later model learns from probabilities such as it will meet, not from fitted ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS = "words_"
FEATURES = "features_"


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the distinct lower-case words of a text: runs of letters and digits; null text has none."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return docs.withColumn(WORDS, F.array_distinct(F.filter(words, lambda w: w != "")))


@dataclass
class Chain:
    """A fitted chain: its words, its categories and one model for each, in order."""

    vocabulary: list[str]
    categories: list[str]
    models: list[LogisticRegressionModel | None]
    thresholds: dict[str, float]

    def probabilities(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with a column p_<category> for each category."""
        rows = with_words(docs, text)
        if self.vocabulary:
            rows = _vectors(rows, self.vocabulary)
        for i, (category, model) in enumerate(zip(self.categories, self.models, strict=True)):
            rows = _predict(_assemble(rows, self.categories[:i]) if model else rows, model, category)
        return rows.drop(WORDS, FEATURES)


def _vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=WORDS, outputCol=FEATURES, minTF=1.0)
    return model.setBinary(True).transform(rows)


def _assemble(rows: DataFrame, earlier: list[str]) -> DataFrame:
    inputs = [FEATURES, *[f"p_{c}" for c in earlier]]
    return VectorAssembler(inputCols=inputs, outputCol="inputs_").transform(rows)


def _predict(rows: DataFrame, model: LogisticRegressionModel | None, category: str) -> DataFrame:
    if model is None:  # nothing to learn from
        return rows.withColumn(f"p_{category}", F.lit(0.0)).drop("inputs_")
    p = vector_to_array("probability_")[1]
    return model.transform(rows).withColumn(f"p_{category}", p).drop("inputs_", "raw_", "probability_", "prediction_")


def _learner(category: str, iterations: int, penalty: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="inputs_", labelCol=f"y_{category}", rawPredictionCol="raw_", probabilityCol="probability_",
        predictionCol="prediction_", maxIter=iterations, regParam=penalty, standardization=False,
    )


def telling_words(labelled: DataFrame, categories: list[str], per_category: int, least: int) -> list[str]:
    """The words whose presence tells most about a category: chi-squared on document counts, ties by word."""
    sums = [F.sum(f"y_{c}").alias(f"n_{c}") for c in categories]
    totals = labelled.agg(F.count("*").alias("n"), *sums).first()
    counts = labelled.select(F.explode(WORDS).alias("word"), *[f"y_{c}" for c in categories]).groupBy("word").agg(
        F.count("*").alias("n"), *sums
    ).where(F.col("n") >= least)
    counts = cut(counts, "word-counts")
    found: set[str] = set()
    n = float(totals["n"])
    for c in categories:
        positive = float(totals[f"n_{c}"] or 0)
        if not 0 < positive < n:
            continue
        a, words = F.col(f"n_{c}"), F.col("n")
        b, d = words - a, F.lit(n - positive)
        x = a * (d - b) - b * (F.lit(positive) - a)
        chi = n * x * x / (words * (n - words) * F.lit(positive) * d)
        top = counts.where(words < n).select("word", chi.alias("chi")).orderBy(F.col("chi").desc(), "word").limit(per_category)
        found.update(r["word"] for r in top.collect())
    return sorted(found)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    sample_rows: int = 12_000,
    folds: int = 3,
    words_per_category: int = 800,
    least_documents: int = 5,
    iterations: int = 20,
    penalty: float = 1e-4,
) -> Chain:
    """Fit a chain on at most ``sample_rows`` labelled documents, drawn by a hash of their id.

    ``labels``: id and one 0/1 column for each of ``categories``; rows with a null label, id or no
    document are left out, of repeated ids one row is used. The bound is on training rows alone;
    scoring covers every document. A category of one class only has the constant probability that
    the model fits to it, near 0 or 1. Without any usable row, so also with empty ``labels`` or
    ``docs``, probabilities are 0 and nothing is predicted. A threshold for each category is chosen
    on the out-of-fold probabilities: the middle of the range with the best F1. With one fold, and
    for a fold that holds all rows, these come from the model of all rows.
    """
    known = labels.select(
        F.col(doc_id).cast("long").alias("label_id"), *[F.col(c).cast("double").alias(f"y_{c}") for c in categories]
    ).dropna().dropDuplicates(["label_id"])
    size = known.count()
    share = min(1.0, sample_rows / max(1, size))
    known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(doc_id).cast("long").alias("label_id"), F.col(text).alias("text")).join(known, "label_id")
    rows = cut(
        with_words(rows).drop("text").dropDuplicates(["label_id"]).withColumn(
            "fold", F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(folds)).cast("int")
        ),
        "labelled",
    )
    if rows.isEmpty():
        return Chain([], list(categories), [None] * len(categories), dict.fromkeys(categories, 0.5))
    vocabulary = telling_words(rows, categories, words_per_category, least_documents) or ["-"]
    rows = _vectors(rows, vocabulary).drop(WORDS).coalesce(6)  # bounded by sample_rows
    models, thresholds = [], {}
    for i, category in enumerate(categories):
        learner, data = _learner(category, iterations, penalty), _assemble(rows, categories[:i]).persist()
        models.append(learner.fit(data))
        parts = []
        for fold in range(folds):
            inside, outside = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
            if inside.isEmpty():
                inside = data
            parts.append(_predict(outside, learner.fit(inside), category))
        out_of_fold = parts[0]
        for part in parts[1:]:
            out_of_fold = out_of_fold.unionByName(part)
        rows = cut(out_of_fold, "out-of-fold")
        thresholds[category] = _threshold(rows, category)
        data.unpersist()
    return Chain(vocabulary, list(categories), models, thresholds)


def _threshold(rows: DataFrame, category: str, steps: int = 200) -> float:
    """The middle of the probabilities that give the best F1, on a grid of ``steps``."""
    counts = rows.groupBy(F.floor(F.col(f"p_{category}") * steps).alias("bin")).agg(
        F.sum(f"y_{category}").alias("yes"), F.count("*").alias("all")
    )
    found = {r["bin"]: (r["yes"], r["all"]) for r in counts.collect()}  # at most steps + 1 rows
    positive = sum(y for y, _ in found.values())
    scores, tp, n = [], 0.0, 0
    for b in range(steps, 0, -1):
        y, k = found.get(b, (0, 0))
        tp, n = tp + y, n + k
        scores.append((2 * tp / max(1.0, n + positive), b / steps))
    best = max(scores)[0]
    good = [t for f, t in scores if f >= best - 1e-9]
    return (min(good) + max(good)) / 2


def score(docs: DataFrame, chain: Chain, category: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, p_<category> for each category, and whether ``category`` is predicted.

    Null, empty or blank texts have no words and are scored by the models' constants; rows that
    repeat are scored each; columns other than id and text aren't read. An empty table gives no rows.
    """
    rows = chain.probabilities(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return rows.select(
        F.col("doc_id").alias(doc_id),
        *[f"p_{c}" for c in chain.categories],
        (F.col(f"p_{category}") >= chain.thresholds[category]).alias(category),
    )


def keep_clean(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``category`` isn't predicted for."""
    packed = docs.select(F.struct(*docs.columns).alias("row_"), F.col(text).alias("text"))
    rows = chain.probabilities(packed)
    return rows.where(F.col(f"p_{category}") < chain.thresholds[category]).select("row_.*")
