"""Personal data: counts, score, masked detail and the corpus report."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import patterns as P
from wardspark.functions import text as T
from wardspark.functions.masking import mask_pii
from wardspark.session import compute_once

CATEGORIES = list(P.PII_PATTERNS)

# Characters a match can begin with; e-mails may begin with nearly any.
STARTS = {
    "phone_us": r"[+(\d]", "phone_intl": r"[+1-9]", "ssn": r"\d", "credit_card": r"[1-6]",
    "ip_address": r"[0-9]", "date_of_birth": r"[0-2]", "address": r"\d", "zip_code": r"\d",
    "passport": r"[A-Z]", "drivers_license": r"[A-Z]",
}


def enabled(categories=None) -> list[str]:
    """The requested known categories, or all; unknown names are ignored."""
    return [c for c in categories if c in P.PII_PATTERNS] if categories else CATEGORIES


def _possible(text: Column, category: str) -> Column:
    """What any match needs: an at sign in e-mails, a digit elsewhere."""
    if category == "email":
        return text.contains("@")
    return text.rlike(T.DIGIT)


def _regex(category: str) -> Column:
    """The category's pattern, tried only where its first character may stand: word edges
    are costly to test at every position."""
    pattern, ignore_case = P.PII_PATTERNS[category]
    start = STARTS.get(category)
    if start:
        pattern = f"(?={start})(?:{pattern})"
    return F.lit(T.spark_regex(pattern, ignore_case))


def _emails(text: Column) -> Column:
    """The e-mails of a text, in linear time.

    If none begins at the first word edge of a run of characters that may stand before the at
    sign, none begins later in that run, so the rest of the run is passed over.
    """
    pattern, ignore_case = P.PII_PATTERNS["email"]
    either = T.spark_regex(rf"({pattern})|\b[A-Za-z0-9._%+-]++", ignore_case)
    return F.array_remove(F.regexp_extract_all(text, F.lit(either), F.lit(1)), "")


def _found(text: Column, category: str) -> Column:
    if category == "email":
        return _emails(text)
    return F.regexp_extract_all(text, _regex(category), F.lit(0))


def _number(text: Column, category: str) -> Column:
    return (F.size(_emails(text)) if category == "email"
            else F.regexp_count(text, _regex(category)))


def counts(text: Column, categories=None) -> dict[str, Column]:
    return {c: F.when(_possible(text, c), _number(text, c)).otherwise(0)
            for c in enabled(categories)}


def matches(text: Column, categories=None) -> dict[str, Column]:
    nothing = F.array().cast("array<string>")
    return {c: F.when(_possible(text, c), _found(text, c)).otherwise(nothing) for c in enabled(categories)}


def total_of(found: dict[str, Column]) -> Column:
    return reduce(operator.add, found.values()) if found else F.lit(0)


def score_of(total: Column) -> Column:
    return (F.when(total == 0, 0.0).when(total == 1, 0.5).when(total <= 3, 0.75)
            .otherwise(1.0))


def score(text: Column, categories=None) -> Column:
    return score_of(total_of(counts(text, categories)))


def _masked(values: Column, category: str) -> Column:
    return F.transform(values, lambda v: mask_pii(v, category))


def detail_of(found: dict[str, Column]) -> Column:
    """Detail struct from the match arrays of each category."""
    names = F.array(*[F.lit(c) for c in found])
    masked = F.array(*[_masked(m, c) for c, m in found.items()])
    by_category = F.map_filter(F.map_from_arrays(names, masked), lambda _, v: F.size(v) > 0)
    return F.struct(
        T.keep_present(*[F.when(F.size(m) > 0, F.lit(c)) for c, m in found.items()])
        .alias("categories_found"),
        total_of({c: F.size(m) for c, m in found.items()}).alias("total_matches"),
        by_category.alias("matches_by_category"))


def detail(text: Column, categories=None) -> Column:
    return detail_of(matches(text, categories))


def detected_items(info: Column) -> Column:
    return F.transform(
        info["categories_found"],
        lambda c: F.concat(c, F.lit(": "), F.size(info["matches_by_category"][c]).cast("string"),
                           F.lit(" found")))


def pii_counts(df: DataFrame, text: str, categories=None) -> DataFrame:
    found = {f"{c}_count": n for c, n in counts(F.col(text), categories).items()}
    out = compute_once(df.withColumns(found), df.columns, list(found))
    return out.withColumn("total_matches", total_of({c: F.col(c) for c in found}))


def pii_score(df: DataFrame, text: str, threshold: float = 0.1, categories=None) -> DataFrame:
    return (pii_counts(df, text, categories).withColumn("score", score_of(F.col("total_matches")))
            .withColumn("passed", F.col("score") <= threshold))


def pii_detail(df: DataFrame, text: str, categories=None) -> DataFrame:
    found = {f"_{c}": m for c, m in matches(F.col(text), categories).items()}
    out = compute_once(df.withColumns(found), df.columns, list(found))
    out = out.withColumn("pii", detail_of({c[1:]: F.col(c) for c in found})).drop(*found)
    return out.withColumn("detected_items", detected_items(F.col("pii")))


def pii_report(df: DataFrame, text: str, categories=None) -> DataFrame:
    """Documents and matches per category over the whole table.

    One row of sums over the text, turned on its side: nothing but the sums is shuffled.
    """
    found = enabled(categories)
    counted = pii_counts(df, text, categories)
    sums = counted.agg(*[F.struct(
        F.sum(F.col(f"{c}_count")).alias("matches"),
        F.count_if(F.col(f"{c}_count") > 0).alias("documents")).alias(c) for c in found])
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c)["documents"].alias("documents"),
                              F.col(c)["matches"].alias("matches")) for c in found])
    return sums.select(F.inline(rows)).filter("documents > 0")
