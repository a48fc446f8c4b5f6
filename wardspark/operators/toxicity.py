"""Toxicity from category scores, and the hook for models that give them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import hashing
from wardspark.functions import text as T


def score(categories: Column, text: Column) -> Column:
    """Highest category score; 0 on blank text or without category scores."""
    top = F.array_max(F.map_values(categories))
    return F.when(T.is_blank(text), 0.0).otherwise(F.coalesce(top, F.lit(0.0)))


def detail(categories: Column) -> Column:
    """The category scores and the first category with the highest one."""
    top = F.array_max(F.map_values(categories))
    first = F.filter(F.map_entries(categories), lambda e: e["value"] == top)
    return F.struct(categories.alias("categories"), F.get(first, 0)["key"].alias("max_category"))


def detected_items(categories: Column, threshold: float) -> Column:
    return F.map_keys(F.map_filter(categories, lambda _, v: v > threshold))


def toxicity_score(df: DataFrame, categories: str, text: str,
                   threshold: float = 0.7) -> DataFrame:
    return (df.withColumn("score", score(F.col(categories), F.col(text)))
            .withColumn("passed", F.col("score") <= threshold))


def toxicity_detail(df: DataFrame, categories: str, threshold: float = 0.7) -> DataFrame:
    return (df.withColumn("toxicity", detail(F.col(categories)))
            .withColumn("detected_items", detected_items(F.col(categories), threshold)))


def model_scorer(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]):
    """Column function for a text classifier.

    ``load`` runs once per task and returns a function from texts to category scores.
    The result is ``STRUCT<scores, error>``: a text the model fails on has an error and
    no scores, and the others of its batch are scored.
    """
    @F.pandas_udf("scores map<string,double>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()

        def one(value):
            if value is None or not value.strip():
                return {}, None
            try:
                return {k: float(v) for k, v in predict([value])[0].items()}, None
            except Exception as problem:  # noqa: BLE001 - reported per row
                return None, str(problem)

        for values in batches:
            try:
                full = [v if v is not None and v.strip() else None for v in values]
                found = iter(predict([v for v in full if v is not None]))
                rows = [({} if v is None else {k: float(s) for k, s in next(found).items()}, None)
                        for v in full]
            except Exception:  # noqa: BLE001 - find the failing rows one by one
                rows = [one(v) for v in values]
            yield pd.DataFrame(rows, columns=["scores", "error"], index=values.index)

    return run


def train_stand_in(labelled: DataFrame, text: str, label: str, features: int = 1 << 14,
                   penalty: float = 1e-3, tolerance: float = 1e-8, rounds: int = 500) -> PipelineModel:
    """Logistic regression on TF-IDF, fitted to convergence, for use where no pretrained model is at hand.

    Words between white space, lower-cased, are hashed to ``features`` places. Both labels, 0 and 1, must occur; rows
    without a label are left out. The loss is the mean log loss and ``penalty / 2`` times the squared weights.
    """
    data = labelled.filter(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("label"))
    return Pipeline(stages=[
        Tokenizer(inputCol="_text", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weights"),
        LogisticRegression(featuresCol="_weights", regParam=penalty, tol=tolerance, maxIter=rounds,
                           standardization=False)]).fit(data)


def train_bayes(labelled: DataFrame, text: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """Naive Bayes over hashed word counts: a weaker stand-in, fitted in one pass.

    Both labels, 0 and 1, must occur; rows without a label are left out.
    """
    data = labelled.filter(F.col(label).isNotNull()).select(
        hashing.word_buckets(F.col(text), features).alias("_words"),
        F.col(label).cast("double").alias("label"))
    counter = hashing.bucket_counter(features, "_words", "_counts")
    model = NaiveBayes(featuresCol="_counts", smoothing=1.0).fit(counter.transform(data))
    return PipelineModel([counter, model])


def toxicity_model(df: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    """``toxicity_scores MAP<STRING, DOUBLE>`` from a stand-in model."""
    if isinstance(model.stages[0], Tokenizer):
        read = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    else:
        read = df.withColumn("_words", hashing.word_buckets(F.col(text), len(model.stages[0].vocabulary)))
    return model.transform(read).select(
        *[F.col(c) for c in df.columns],
        F.create_map(F.lit("toxicity"), vector_to_array("probability")[1])
        .alias("toxicity_scores"))
