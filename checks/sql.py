"""Detector formulas as DuckDB SQL, written apart from the Spark ones.

DuckDB's regex engine has no back-references, and its shorthand classes are ASCII: where
that matters on the test tables, both are spelt out.
"""

from __future__ import annotations

import re
import string

from checks.planting import quoted
from wardspark.functions import patterns as P


def lexicon_hits(low: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({low}, {quoted(w)})::INT" for w in words) + ")"


def lexicon_list(low: str, words: list[str], sep: str = "|") -> str:
    listed = ", ".join(quoted(w) for w in words)
    return f"array_to_string(list_filter([{listed}], lambda k: contains({low}, k)), '{sep}')"


def contradiction_hits(low: str) -> str:
    parts = []
    for p in P.CONTRADICTIONS:
        if r"\1" in p:  # spell the repeated first character out
            p = "|".join(p.replace(r"(\w)", c).replace(r"\1", c)
                         for c in string.ascii_lowercase + string.digits + "_àâäçéèêëîïôöùûüß")
        p = p.replace(r"\w", r"[\p{L}\p{N}_]")
        parts.append(f"regexp_matches({low}, {quoted(p)})::INT")
    return "(" + " + ".join(parts) + ")"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def blank(text: str) -> str:
    return f"(length(trim({text})) = 0)"


def hallucination(text: str) -> str:
    low = f"lower({text})"
    return (f"CASE WHEN {blank(text)} THEN 0.0::DOUBLE ELSE least("
            f"least({lexicon_hits(low, P.UNCERTAINTY)} / 4.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE"
            f" + least({lexicon_hits(low, P.OVERCONFIDENCE)} / 3.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE"
            f" + least({lexicon_hits(low, P.FABRICATION)} / 2.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE"
            f" + least({contradiction_hits(low)} / 2.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE"
            f" + least({words(text)} / 500.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE * 0.05::DOUBLE"
            f", 1.0::DOUBLE) END")


def pii_matches(text: str, category: str) -> str:
    pattern, ignore = P.PII_PATTERNS[category]
    return f"regexp_extract_all({text}, {quoted(('(?i)' if ignore else '') + pattern)})"


def pii_count(text: str, category: str) -> str:
    return f"len({pii_matches(text, category)})"


def pii_total(text: str, categories=None) -> str:
    return "(" + " + ".join(pii_count(text, c) for c in categories or P.PII_PATTERNS) + ")"


def pii_score(total: str) -> str:
    return (f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE WHEN {total} = 1 THEN 0.5::DOUBLE "
            f"WHEN {total} <= 3 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END")


def mask(value: str, category: str) -> str:
    generic = (f"CASE WHEN length({value}) > 4 THEN left({value}, 2) || '***' || right({value}, 2) "
               f"ELSE '***' END")
    if category == "email":
        return (f"CASE WHEN len(string_split({value}, '@')) = 2 THEN "
                f"left(string_split({value}, '@')[1], 2) || '***@' || string_split({value}, '@')[2] "
                f"ELSE {generic} END")
    if category in ("ssn", "credit_card"):
        return f"'***' || right({value}, 4)"
    if category == "phone_us":
        return f"'***-***-' || right({value}, 4)"
    return generic


def injection_hit(text: str, category: str) -> str:
    alternatives = "|".join(f"(?:{p})" for p in P.INJECTION_PATTERNS[category][1])
    return f"regexp_matches(lower({text}), {quoted('(?i)' + alternatives)})"


def injection_score(text: str) -> str:
    return "greatest(" + ", ".join(
        f"CASE WHEN {injection_hit(text, c)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"
        for c, (w, _) in P.INJECTION_PATTERNS.items()) + ")"


def injection_matches(text: str, category: str) -> str:
    """All matched texts of a category, pattern by pattern."""
    parts = [f"regexp_extract_all(lower({text}), {quoted('(?i)' + p)})"
             for p in P.INJECTION_PATTERNS[category][1]]
    return "flatten([" + ", ".join(parts) + "])"


def valid(rule) -> bool:
    try:
        re.compile(rule.pattern)
        return True
    except re.error:
        return rule.rule_type != "regex"


def rule_fires(text: str, rule) -> str:
    if rule.rule_type == "regex":
        return f"regexp_matches({text}, {quoted('(?i)' + rule.pattern)})"
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(k)})" for k in rule.keywords) + ")"


def active(rules, target: str):
    return [r for r in rules if r.enabled and valid(r) and r.apply_to in (target, "both")]


def rule_score(text: str, rules, target: str) -> str:
    cases = [f"CASE WHEN {rule_fires(text, r)} THEN {r.severity}::DOUBLE ELSE 0.0::DOUBLE END"
             for r in active(rules, target)]
    return (f"CASE WHEN {text} IS NULL OR {text} = '' THEN 0.0::DOUBLE "
            f"ELSE greatest({', '.join(cases)}, 0.0::DOUBLE) END")


def rule_ids(text: str, rules, target: str, field: str = "rule_id") -> str:
    """List of ``field`` of the rules that fire, in order."""
    cases = [f"CASE WHEN {rule_fires(text, r)} THEN {quoted(str(getattr(r, field)))} END"
             for r in active(rules, target)]
    return (f"CASE WHEN {text} IS NULL OR {text} = '' THEN [] ELSE "
            f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) END")


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def word_buckets(text: str, buckets: int) -> str:
    """List of bucket numbers, one per word."""
    split = f"regexp_split_to_array(lower(coalesce({text}, '')), '[ \\t\\n\\x0B\\f\\r]+')"
    found = f"list_filter({split}, lambda w: w <> '')"
    return f"list_transform({found}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % {buckets})"
