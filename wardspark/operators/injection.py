"""Prompt injection: categories, score and detail of a text column."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import patterns as P
from wardspark.functions import text as T
from wardspark.session import compute_once

CATEGORIES = list(P.INJECTION_PATTERNS)

# For each pattern, in the same order, words of which every match holds at least one.
# A substring test is far cheaper than a regular expression, so the expression runs only
# on texts that can match at all.
ANCHORS = {
    "role_manipulation": [["ignore"], ["disregard"], ["forget"], ["now"], ["pretend"], ["act"],
                          ["now"], ["new"], ["switch"]],
    "extraction": [["system", "initial", "original"], ["system", "initial", "original"],
                   ["repeat"], ["echo"], ["secret", "hidden"]],
    "delimiter": [["<|"], ["inst]"], ["sys>>"], ["```"], ["###"]],
    "jailbreak": [["dan"], ["jailbr"], ["bypass"], ["developer"], ["sudo"], ["god"],
                  ["unrestricted"], ["restriction"], ["remove"], ["disable"]],
    "social_engineering": [["please"], ["urgent", "emergency", "death"], ["boss"],
                           ["fired", "trouble"], ["between"], ["anyone"], ["purpose"]],
}


# A marker's end is looked for once per line, after the line's first opening: if there is none,
# later openings on the line have none either. The whole match is the first group.
_MARKER = r"<\|.*?\|>"
_HAS_MARKER = r"(?dm)^(?>[^\n]*?<\|)[^\n]*?\|>"
_MARKERS = r"(?d)(<\|[^\n]*?\|>)|<\|[^\n]*+"


def _guarded(category: str):
    return zip(P.INJECTION_PATTERNS[category][1], ANCHORS[category])


def _occurs(folded: Column, pattern: str, words: list[str]) -> Column:
    exact = _HAS_MARKER if pattern == _MARKER else T.spark_regex(pattern.lower())
    return T.contains_any(folded, words) & folded.rlike(exact)


def _extracted(low: Column, pattern: str) -> Column:
    if pattern == _MARKER:
        return F.array_remove(F.regexp_extract_all(low, F.lit(_MARKERS), F.lit(1)), "")
    return F.regexp_extract_all(low, F.lit(T.spark_regex(pattern, True)), F.lit(0))


def prepared(text: Column) -> dict[str, Column]:
    """Forms of a text that the matchers share; to be columns of an earlier projection."""
    return {"low": F.lower(text), "folded": T.fold_case(text)}


def categories(folded: Column) -> dict[str, Column]:
    """Per category, whether any of its patterns occurs in the case-folded text."""
    out = {}
    for category in CATEGORIES:
        hits = [_occurs(folded, pattern, words) for pattern, words in _guarded(category)]
        out[category] = F.coalesce(reduce(operator.or_, hits), F.lit(False))
    return out


def score_of(hits: dict[str, Column]) -> Column:
    return F.greatest(*[F.when(hit, P.INJECTION_PATTERNS[c][0]).otherwise(0.0)
                        for c, hit in hits.items()])


def score(text: Column) -> Column:
    return score_of(categories(T.fold_case(text)))


def matches(low: Column, folded: Column) -> dict[str, Column]:
    """Per category, the matched texts pattern by pattern."""
    nothing = F.array().cast("array<string>")
    out = {}
    for category in CATEGORIES:
        parts = [F.when(_occurs(folded, pattern, words), _extracted(low, pattern))
                 .otherwise(nothing) for pattern, words in _guarded(category)]
        out[category] = F.coalesce(F.concat(*parts), nothing)
    return out


def detail_of(found: dict[str, Column]) -> Column:
    """Detail struct from the matches of each category, shown cut at 50 characters."""
    names = F.array(*[F.lit(c) for c in found])
    shown = F.array(*[F.transform(m, lambda v: F.substring(v, 1, 50)) for m in found.values()])
    by_category = F.map_filter(F.map_from_arrays(names, shown), lambda _, v: F.size(v) > 0)
    value = score_of({c: F.size(m) > 0 for c, m in found.items()})
    count = F.lit(0)
    for m in found.values():
        count = count + F.size(m)
    return F.struct(
        T.keep_present(*[F.when(F.size(m) > 0, F.lit(c)) for c, m in found.items()])
        .alias("categories_detected"),
        count.alias("total_patterns_matched"),
        by_category.alias("matches_by_category"),
        F.when(value > 0.7, "high").when(value > 0.4, "medium").otherwise("low")
        .alias("risk_level"))


def detail(text: Column) -> Column:
    return detail_of(matches(F.lower(text), T.fold_case(text)))


def detected_items(info: Column) -> Column:
    return F.transform(
        info["categories_detected"],
        lambda c: F.concat(c, F.lit(": "), F.size(info["matches_by_category"][c]).cast("string"),
                           F.lit(" pattern(s)")))


def injection_categories(df: DataFrame, text: str) -> DataFrame:
    folded = df.withColumn("_folded", T.fold_case(F.col(text)))
    return compute_once(folded.withColumns(categories(F.col("_folded"))), df.columns, CATEGORIES)


def injection_score(df: DataFrame, text: str, threshold: float = 0.5) -> DataFrame:
    hit = injection_categories(df, text)
    return (hit.withColumn("score", score_of({c: F.col(c) for c in CATEGORIES}))
            .withColumn("passed", F.col("score") <= threshold))


def injection_detail(df: DataFrame, text: str) -> DataFrame:
    forms = df.withColumns({f"_{k}": c for k, c in prepared(F.col(text)).items()})
    found = {f"_{c}": m for c, m in matches(F.col("_low"), F.col("_folded")).items()}
    out = compute_once(forms.withColumns(found), df.columns, list(found))
    info = detail_of({c[1:]: F.col(c) for c in found})
    out = out.withColumn("prompt_injection", info).drop(*found)
    return out.withColumn("detected_items", detected_items(F.col("prompt_injection")))
