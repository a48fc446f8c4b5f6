"""Hallucination signals, score and detail of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import patterns as P
from wardspark.functions import text as T
from wardspark.session import compute_once

SIGNALS = ["uncertainty", "overconfidence", "fabrication", "contradiction", "words"]

# Words without which a contradiction pattern cannot match.
_CONTRADICTION_NEEDS = [["is", "not"], ["always", "never"], ["all", "no"]]
# The second one asks for both words on a line, in any order; so put, it takes linear time.
_SAME_LINE = r"(?dm)^(?=[^\n]*always)[^\n]*never"


def signals(text: Column, low: Column | None = None) -> dict[str, Column]:
    """Counts per signal; all zero on blank text. ``low`` is the lower-cased text, best given
    as a column of an earlier projection."""
    low = F.lower(text) if low is None else low
    lexicons = {"uncertainty": P.UNCERTAINTY, "overconfidence": P.OVERCONFIDENCE,
                "fabrication": P.FABRICATION}
    out = {name: T.total([low.contains(k) for k in keys])
           for name, keys in lexicons.items()}
    contradictions = []
    for pattern, needs in zip(P.CONTRADICTIONS, _CONTRADICTION_NEEDS):
        first, second = (low.contains(w) for w in needs)
        exact = _SAME_LINE if needs == ["always", "never"] else T.spark_regex(pattern)
        contradictions.append(first & second & low.rlike(exact))
    out["contradiction"] = T.total(contradictions)
    out = {name: F.coalesce(c, F.lit(0)) for name, c in out.items()}
    out["words"] = T.word_count(text)
    return out


def score_of(found: dict[str, Column]) -> Column:
    """Weighted sum of the saturated signals; blank text has no words and scores 0."""
    risk = None
    for name, (cap, weight) in P.HALLUCINATION_WEIGHTS.items():
        count = found["words" if name == "length" else name].cast("double")
        part = F.least(count / F.lit(cap), F.lit(1.0))
        if name == "length":
            part = part * F.lit(0.5)
        part = part * F.lit(weight)
        risk = part if risk is None else risk + part
    # a factor, not a branch: Spark shares repeated parts only outside of branches
    return F.least(risk, F.lit(1.0)) * F.when(found["words"] == 0, 0.0).otherwise(1.0)


def score(text: Column) -> Column:
    return score_of(signals(text))


def _phrases(low: Column, lexicon: list[str]) -> Column:
    return T.keep_present(*[F.when(low.contains(k), k) for k in lexicon])


def detail(text: Column) -> Column:
    low = F.lower(text)
    found = {"uncertainty_phrases": P.UNCERTAINTY, "overconfidence_phrases": P.OVERCONFIDENCE,
             "fabrication_indicators": P.FABRICATION}
    return F.struct(
        *[_phrases(low, lexicon).alias(name) for name, lexicon in found.items()],
        T.word_count(text).alias("word_count"))


def detected_items(info: Column) -> Column:
    return F.concat(info["uncertainty_phrases"], info["overconfidence_phrases"],
                    info["fabrication_indicators"])


def hallucination_signals(df: DataFrame, text: str) -> DataFrame:
    found = {f"{k}_hits" if k != "words" else "word_count": c
             for k, c in signals(F.col(text), F.col("_lower")).items()}
    lowered = df.withColumn("_lower", F.lower(F.col(text)))
    return compute_once(lowered.withColumns(found), df.columns, list(found))


def hallucination_score(df: DataFrame, text: str, threshold: float = 0.6) -> DataFrame:
    scored = hallucination_signals(df, text)
    found = {k: F.col(f"{k}_hits" if k != "words" else "word_count") for k in SIGNALS}
    return (scored.withColumn("score", score_of(found))
            .withColumn("passed", F.col("score") <= threshold))


def hallucination_detail(df: DataFrame, text: str) -> DataFrame:
    return (df.withColumn("hallucination", detail(F.col(text)))
            .withColumn("detected_items", detected_items(F.col("hallucination"))))
