"""One markdown report per evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators.projections import metric_status, recommendations

_ICONS = {"green": "🟢", "orange": "🟡"}


def _title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _table(heads: str, entries: Column, value) -> Column:
    rows = F.transform(entries, lambda e: F.concat(
        F.lit("| "), _title(e["key"]), F.lit(" | "), value(e["value"]), F.lit(" |")))
    return F.when(F.size(entries) > 0, _lines(F.lit(heads), F.array_join(rows, "\n")))


def _pii_section(found: Column) -> Column:
    kinds = F.map_entries(found["matches_by_category"])
    return F.when(F.size(kinds) > 0, F.array_join(F.transform(kinds, lambda e: F.concat(
        F.lit("- **"), _title(e["key"]), F.lit("**: "), F.size(e["value"]).cast("string"),
        F.lit(" found"))), "\n"))


def _injection_section(found: Column) -> Column:
    kinds = found["categories_detected"]
    return F.when(F.size(kinds) > 0, F.concat(
        F.lit("- **Detected patterns**: "), F.array_join(kinds, ", "),
        F.lit("\n- **Severity**: "), found["risk_level"]))


def _toxicity_section(found: Column) -> Column:
    return _table("| Category | Score |\n|---|---|", F.map_entries(found["categories"]),
                  lambda v: F.format_number(v, 3))


def _hallucination_section(found: Column) -> Column:
    kinds = ["uncertainty_phrases", "overconfidence_phrases", "fabrication_indicators"]
    counts = F.array(*[F.struct(F.lit(k).alias("key"), F.size(found[k]).alias("value"))
                       for k in kinds])
    return _table("| Indicator | Found |\n|---|---|", F.filter(counts, lambda e: e["value"] > 0),
                  lambda v: v.cast("string"))


def _rules_section(found: Column) -> Column:
    rules = found["triggered_rules"]
    return F.when(F.size(rules) > 0, F.array_join(F.transform(rules, lambda r: F.concat(
        F.lit("- **"), r["name"], F.lit("**: "), r["action"])), "\n"))


_SECTIONS = {"pii": _pii_section, "prompt_injection": _injection_section,
             "toxicity": _toxicity_section, "hallucination": _hallucination_section,
             "custom_rules": _rules_section}


def sections(df: DataFrame, detailed: str = "detailed_results") -> Column:
    """Detail sections from the results that ``evaluate`` gives with ``details``: one per evaluator
    that found something, empty if none did."""
    ran = df.schema[detailed].dataType.names
    parts = []
    for name, build in _SECTIONS.items():
        if name in ran:
            body = build(F.col(detailed)[name]["details"])
            parts.append(F.concat(F.lit("### "), _title(F.lit(name)), F.lit("\n"), body))
    return F.concat_ws("\n", *parts) if parts else F.lit("")


def report_rows(df: DataFrame, generated_at: str, detail: Column | None = None,
                detailed: str | None = None) -> DataFrame:
    """Adds ``report``: input, verdict, scores, issues, details and advice.

    ``generated_at`` is the time to print; ``detail`` is an optional array of lines, ``detailed`` the
    column of detailed results to make sections of.
    """
    icon = F.lit("🔴")
    entries = F.array_sort(F.map_entries("scores"))

    def line(e):
        color = metric_status(e["key"], e["value"])
        mark = (F.when(color == "green", _ICONS["green"]).when(color == "orange", _ICONS["orange"])
                .otherwise(icon))
        return F.concat(F.lit("- "), mark, F.lit(" **"), _title(e["key"]), F.lit("**: "),
                        F.format_number(e["value"], 3))

    issues = F.when(F.size("flags") > 0, _lines(F.lit("### Issues Detected"), _bullets(F.col("flags")))
                    ).otherwise(F.lit("### No Issues Detected"))
    status = F.when(F.col("passed"), "PASSED").otherwise("FAILED")
    parts = [
        F.lit("# Evaluation Report"), F.lit(""),
        F.lit(f"**Generated**: {generated_at}"), F.lit(""),
        F.lit("## Input"), F.lit(""),
        F.lit("### Prompt"), F.lit("```"), F.coalesce("prompt", F.lit("N/A")), F.lit("```"),
        F.lit("### Response"), F.lit("```"), F.coalesce("response", F.lit("N/A")), F.lit("```"),
        F.lit("## Evaluation Results"), F.lit(""),
        F.concat(F.lit("**Overall Status**: "), status), F.lit(""),
        F.lit("### Scores"), F.array_join(F.transform(entries, line), "\n"), F.lit(""),
        issues, F.lit("")]
    if detail is not None or detailed is not None:
        parts.append(F.lit("## Detailed Analysis"))
    if detailed is not None:
        found = sections(df, detailed)
        parts.append(F.when(found != "", found))
    if detail is not None:
        parts.append(_bullets(detail))
    if detail is not None or detailed is not None:
        parts.append(F.lit(""))
    parts += [F.lit("## Recommendations"),
              _bullets(recommendations(F.col("scores"), F.col("passed")))]
    return df.withColumn("report", _lines(*parts))
