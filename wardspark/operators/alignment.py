"""Prompt-response alignment from embeddings, and the hook for models that give them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import hashing
from wardspark.functions import text as T


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def score(prompt: Column, response: Column, prompt_vector: Column,
          response_vector: Column) -> Column:
    """Cosine of the two embeddings; 0 where a text or an embedding is missing."""
    missing = (T.is_empty(prompt) | T.is_empty(response)
               | prompt_vector.isNull() | response_vector.isNull())
    return F.when(missing, 0.0).otherwise(cosine(prompt_vector, response_vector))


def detail(value: Column, prompt: Column, response: Column) -> Column:
    level = (F.when(value >= 0.8, "high").when(value >= 0.5, "moderate")
             .when(value >= 0.3, "low").otherwise("very_low"))
    return F.struct(level.alias("alignment_level"), T.word_count(prompt).alias("prompt_length"),
                    T.word_count(response).alias("response_length"))


def alignment_score(df: DataFrame, prompt: str, response: str, prompt_vector: str,
                    response_vector: str, threshold: float = 0.5) -> DataFrame:
    value = score(F.col(prompt), F.col(response), F.col(prompt_vector), F.col(response_vector))
    return df.withColumn("score", value).withColumn("passed", F.col("score") >= threshold)


def alignment_detail(df: DataFrame, value: str, prompt: str, response: str) -> DataFrame:
    return df.withColumn("alignment", detail(F.col(value), F.col(prompt), F.col(response)))


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Column function for a sentence encoder; ``load`` runs once per task.

    The result is ``STRUCT<vector, error>``: a text the model fails on has an error and no vector,
    and the others of its batch have theirs.
    """
    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = load()

        def vectors(texts):
            found = [[float(x) for x in v] for v in encode(texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found

        def one(text):
            try:
                return vectors([text])[0], None
            except Exception as problem:  # noqa: BLE001 - reported per row
                return None, str(problem)

        for values in batches:
            texts = ["" if v is None else v for v in values]
            try:
                rows = [(v, None) for v in vectors(texts)]
            except Exception:  # noqa: BLE001 - find the failing rows one by one
                rows = [one(t) for t in texts]
            yield pd.DataFrame(rows, columns=["vector", "error"], index=values.index)

    return run


def alignment_embed(df: DataFrame, text: str, vector: str, features: int = 256) -> DataFrame:
    """Hashed word counts as a stand-in for sentence embeddings."""
    words = df.withColumn("_words", hashing.word_buckets(F.col(text), features))
    counted = hashing.bucket_counter(features, "_words", "_counts").transform(words)
    return counted.withColumn(vector, vector_to_array("_counts")).drop("_words", "_counts")
