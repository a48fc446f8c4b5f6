"""User-defined rules: hits, score, detail and match statistics.

A list of rules is small and curated, so it is part of the plan: every rule becomes one
literal expression, compiled once per task, and no rule table is joined with the texts. A
table of rules (a DataFrame) may be of any size; only its literals come to the driver, piece by piece, and it is joined
with the texts by an index of what its rules need (``rule_index``).
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.operators import rule_index
from wardspark.session import compute_once

# Up to so many rules the matchers are part of the generated code; more of them would
# outgrow a Java method, and are evaluated as an expression tree instead.
CODEGEN_RULES = 64
MAX_RULES = 100_000  # more than this are refused as part of a plan, not cut; a table of rules has no limit


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    pattern: str = ""
    rule_type: str = "regex"
    severity: float = 0.5
    action: str = "flag"
    apply_to: str = "both"
    enabled: bool = True

    @property
    def keywords(self) -> list[str]:
        return [k.strip().lower() for k in self.pattern.split(",")]


def rules_from_rows(rules) -> list[Rule]:
    """Rules from a DataFrame, rows or dicts; ``id`` and ``type`` may stand for
    ``rule_id`` and ``rule_type``."""
    if isinstance(rules, DataFrame):
        rules = rules.limit(MAX_RULES + 1).collect()
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules don't fit in a plan: give the table to rule_hits, "
                             "rule_score, rule_detail or rule_match_stats")
    out = []
    for r in rules:
        if isinstance(r, Rule):
            out.append(r)
            continue
        d = r.asDict() if isinstance(r, Row) else dict(r)
        d.setdefault("rule_id", d.get("id"))
        d.setdefault("rule_type", d.get("type") or "regex")
        known = {f.name for f in fields(Rule)}
        out.append(Rule(**{k: v for k, v in d.items() if k in known and v is not None}))
    return out


def _problem(spark, rule: Rule) -> str | None:
    """Why a rule can never fire, if so."""
    if rule.rule_type not in ("regex", "keyword"):
        return f"unknown type {rule.rule_type}"
    if rule.rule_type == "keyword":
        return None
    try:
        re.compile(rule.pattern)
        used = [T.spark_regex(rule.pattern, True)]
        if T.folds(rule.pattern):
            used.append(T.spark_regex(rule.pattern.lower()))
        for pattern in used:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        return None
    except Exception as problem:  # noqa: BLE001 - whichever engine refuses it
        return str(problem).splitlines()[0]


def rule_problems(spark, rules) -> DataFrame:
    """``rule_id, problem``: the enabled rules that can't be used, each with the reason."""
    if isinstance(rules, DataFrame):
        return rule_index.table_problems(rules)
    found = [(r.rule_id, _problem(spark, r)) for r in rules_from_rows(rules) if r.enabled]
    return spark.createDataFrame([f for f in found if f[1]], "rule_id string, problem string")


def usable(spark, rules) -> list[Rule]:
    """Enabled rules that can fire, in order; ``rule_problems`` lists the others."""
    problems = {}
    out = []
    for r in rules_from_rows(rules):
        if not r.enabled:
            continue
        kind = (r.rule_type, r.pattern)
        if kind not in problems:
            problems[kind] = _problem(spark, r)
            if problems[kind]:
                warnings.warn(f"rule {r.rule_id}: pattern dropped: {problems[kind]}")
        if not problems[kind]:
            out.append(r)
    return out


def for_target(rules: list[Rule], target: str) -> list[Rule]:
    return [r for r in rules if r.apply_to in (target, "both")]


def _vocabulary(rules: list[Rule]) -> T.Words:
    return T.Words(k for r in rules if r.rule_type == "keyword" for k in r.keywords)


def prepared(text: Column, rules: list[Rule]) -> dict[str, Column]:
    """What the matchers share: the case-folded text and the keywords of all rules that one
    scan has found; to be columns of an earlier projection."""
    return {"folded": T.fold_length(text), "keywords": _vocabulary(rules).found(F.lower(text))}


def _fires(text: Column, forms: dict[str, Column], rule: Rule, words: T.Words) -> Column:
    if rule.rule_type == "keyword":
        return words.has_any(forms["keywords"], rule.keywords)
    if T.folds(rule.pattern):
        return forms["folded"].rlike(T.spark_regex(rule.pattern.lower()))
    return text.rlike(T.spark_regex(rule.pattern, True))


def hit_positions(text: Column, forms: dict[str, Column], rules: list[Rule],
                  on_empty: bool = False) -> Column:
    """Ascending 1-based positions in ``rules`` of those that fire on ``text``.

    No rule fires on empty text, unless ``on_empty``.
    """
    nothing = F.array().cast("array<int>")
    if not rules:
        return nothing
    words = _vocabulary(rules)
    marks = F.array(*[F.when(_fires(text, forms, r, words), i + 1).otherwise(0)
                      for i, r in enumerate(rules)])
    if len(rules) <= CODEGEN_RULES:
        found = F.array_remove(marks, 0)
    else:
        found = F.filter(marks, lambda p: p > 0)
    silent = text.isNull() if on_empty else T.is_empty(text)
    return F.when(silent, nothing).otherwise(found)


def add_hits(df: DataFrame, text: str, rules: list[Rule], out: str,
             on_empty: bool = False) -> DataFrame:
    """``df`` with the positions of the rules that fire on column ``text``."""
    forms = {f"_{k}": c for k, c in prepared(F.col(text), rules).items()}
    hits = hit_positions(F.col(text), {k[1:]: F.col(k) for k in forms}, rules, on_empty)
    return compute_once(df.withColumns(forms).withColumn(out, hits), df.columns, [out])


def _lookup(rules: list[Rule], field: str) -> Column:
    return F.array(*[F.lit(getattr(r, field)) for r in rules])


def score_of(positions: Column, rules: list[Rule]) -> Column:
    """Highest severity among the hits, else 0."""
    if not rules:
        return F.lit(0.0)
    severity = _lookup(rules, "severity").cast("array<double>")
    hit = F.array_max(F.transform(positions, lambda p: F.element_at(severity, p)))
    return F.greatest(F.coalesce(hit, F.lit(0.0)), F.lit(0.0))


def violations(positions: Column, rules: list[Rule]) -> Column:
    """``ARRAY<STRUCT<rule_id, name, severity, action>>`` in rule order."""
    if not rules:
        return F.array().cast(
            "array<struct<rule_id:string,name:string,severity:double,action:string>>")
    known = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"),
                               F.lit(float(r.severity)).alias("severity"),
                               F.lit(r.action).alias("action")) for r in rules])
    return F.transform(positions, lambda p: F.element_at(known, p))


def detail(text: Column, positions: Column, rules: list[Rule]) -> Column:
    """Triggered rules with what they matched, their number, and whether one blocks."""
    low = F.lower(text)
    triggered = []
    for i, r in enumerate(rules):
        if r.rule_type == "regex":
            matched = F.substring(
                F.regexp_substr(text, F.lit(T.spark_regex(r.pattern, True))), 1, 50)
            keywords = F.lit(None).cast("array<string>")
        else:
            matched = F.lit(None).cast("string")
            # an empty keyword is part of the list, so "keep_present" would lose it
            keywords = F.filter(F.array(*[F.lit(k) for k in r.keywords]),
                                lambda k: F.contains(low, k))
        triggered.append(F.when(F.array_contains(positions, i + 1), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"),
            F.lit(float(r.severity)).alias("severity"), F.lit(r.action).alias("action"),
            matched.alias("matched"), keywords.alias("matched_keywords"))))
    hits = F.array_compact(F.array(*triggered)) if rules else F.array().cast(
        "array<struct<rule_id:string,name:string,severity:double,action:string,"
        "matched:string,matched_keywords:array<string>>>")
    return F.struct(F.size(positions).alias("rules_triggered"), hits.alias("triggered_rules"),
                    F.exists(hits, lambda h: h["action"] == "block").alias("blocked"))


def _with_positions(df: DataFrame, text: str, rules, target: str):
    active = for_target(usable(df.sparkSession, rules), target)
    return add_hits(df, text, active, "_hits"), active


def rule_hits(df: DataFrame, text: str, rules, target: str = "both") -> DataFrame:
    """One row per text and rule that fires on it."""
    if isinstance(rules, DataFrame):
        index = rule_index.rule_index(rules, target, df, text)
        return rule_index.indexed_hits(df, text, index).drop("matched", "matched_keywords")
    hit, active = _with_positions(df, text, rules, target)
    # the generator must not multiply the text column: it is dropped before
    return (hit.drop(text).withColumn("_hit", F.explode(violations(F.col("_hits"), active)))
            .select(*[c for c in df.columns if c != text], "_hit.*"))


def rule_score(df: DataFrame, text: str, rules, target: str = "both",
               threshold: float = 0.5) -> DataFrame:
    if isinstance(rules, DataFrame):
        index = rule_index.rule_index(rules, target, df, text)
        return rule_index.indexed_scores(df, text, index, threshold)
    hit, active = _with_positions(df, text, rules, target)
    return (hit.withColumn("score", score_of(F.col("_hits"), active)).drop("_hits")
            .withColumn("passed", F.col("score") <= threshold))


def rule_detail(df: DataFrame, text: str, rules, target: str = "both") -> DataFrame:
    if isinstance(rules, DataFrame):
        return rule_index.indexed_detail(df, text, rule_index.rule_index(rules, target, df, text))
    hit, active = _with_positions(df, text, rules, target)
    return (hit.withColumn("custom_rules", detail(F.col(text), F.col("_hits"), active))
            .drop("_hits")
            .withColumn("detected_items", F.transform("custom_rules.triggered_rules",
                                                      lambda r: r["name"])))


def rule_match_stats(df: DataFrame, text: str, timestamp: str, rules,
                     target: str = "both") -> DataFrame:
    """Number of matches and last match time of every rule, unmatched ones included.

    Matches are counted per task before anything is shuffled.
    """
    if isinstance(rules, DataFrame):
        index = rule_index.rule_index(rules, target, df, text)
        return rule_index.indexed_stats(df, text, timestamp, rules, index)
    active = for_target(usable(df.sparkSession, rules), target)
    listed = rules_from_rows(rules)
    dated = df.select(F.col(text).alias("_text"), F.col(timestamp).alias("_ts"))
    hit = add_hits(dated, "_text", active, "_hits")
    found = (hit.select(F.explode("_hits").alias("_hit"), "_ts")
             .groupBy("_hit").agg(F.count("*").alias("match_count"),
                                  F.max("_ts").alias("last_matched_at")))
    position = {r.rule_id: i + 1 for i, r in enumerate(active)}
    spark = df.sparkSession
    known = spark.createDataFrame([(r.rule_id, position.get(r.rule_id, 0)) for r in listed],
                                  "rule_id string, _hit int")
    return (known.join(found, "_hit", "left")
            .select("rule_id", F.coalesce("match_count", F.lit(0)).alias("match_count"),
                    "last_matched_at"))
