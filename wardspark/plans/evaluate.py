"""The whole evaluation of prompt-response pairs as one chain of projections.

Columns are added stage by stage: match counts, scores, flags, verdict. Each match is
computed once and everything else is derived from it; a disabled evaluator adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.config import SCORE_KEYS, EvalConfig
from wardspark.functions import hashing
from wardspark.functions import text as T
from wardspark.operators import alignment, hallucination, injection, pii, rules, toxicity
from wardspark.session import compute_once

# --- fixed values: flag texts, each followed by ": " and the score with two decimals ---

FLAG_TEXTS = {
    "toxicity": "High toxicity detected",
    "alignment": "Low prompt-response alignment",
    "hallucination": "Potential hallucination detected",
    "pii": "PII detected in",
    "prompt_injection": "Potential prompt injection",
    "custom_rules": "Custom rule violation",
}


@dataclass(frozen=True)
class PairColumns:
    """Names of the input columns; the last five are optional model outputs."""

    id: str = "id"
    prompt: str = "prompt"
    response: str = "response"
    context: str = "context"
    toxicity: str = "toxicity_scores"
    toxicity_error: str = "toxicity_error"
    prompt_vector: str = "prompt_vector"
    response_vector: str = "response_vector"
    alignment_error: str = "alignment_error"


def exceeds(name: str, value: Column, threshold: Column) -> Column:
    """Whether a score is to be flagged; an undefined score never is."""
    worse = value < threshold if name == "alignment" else value > threshold
    return F.coalesce(worse, F.lit(False))


def flag_text(name: str, value: Column, in_prompt: Column) -> Column:
    label = F.lit(FLAG_TEXTS[name])
    if name == "pii":
        label = F.concat(label, F.lit(" "), F.when(in_prompt, "prompt").otherwise("response"))
    return F.concat(label, F.lit(": "), T.two_decimals(value))


class _Plan:
    def __init__(self, df: DataFrame, config: EvalConfig, rule_list, names: PairColumns):
        self.df, self.config, self.names = df, config, names
        self.prompt, self.response = F.col(names.prompt), F.col(names.response)
        active = rules.usable(df.sparkSession, rule_list) if config.custom_rules else []
        self.prompt_rules = rules.for_target(active, "prompt")
        self.response_rules = rules.for_target(active, "response")

    def optional(self, name: str, kind: str) -> Column:
        return F.col(name) if name in self.df.columns else F.lit(None).cast(kind)

    # -- per evaluator: columns with matches, then the score made of them --

    def prepared(self, name: str) -> dict[str, Column]:
        """Columns that the matches share."""
        if name == "hallucination":
            return {"lower_response": F.lower(self.response)}
        if name == "prompt_injection":
            return {f"{k}_prompt": c for k, c in injection.prepared(self.prompt).items()}
        if name != "custom_rules":
            return {}
        sides = (("prompt", self.prompt, self.prompt_rules),
                 ("response", self.response, self.response_rules))
        return {f"rules_{side}_{k}": c for side, text, active in sides
                for k, c in rules.prepared(text, active).items()}

    def rule_hits(self, side: str) -> Column:
        text, active = ((self.prompt, self.prompt_rules) if side == "prompt"
                        else (self.response, self.response_rules))
        forms = {k: F.col(f"_rules_{side}_{k}") for k in ("keywords", "folded")}
        return rules.hit_positions(text, forms, active)

    def matches(self, name: str) -> dict[str, Column]:
        c, n = self.config, self.names
        if name == "toxicity":
            return {"toxicity_input": self.optional(n.toxicity, "map<string,double>")}
        if name == "alignment":
            return {}
        if name == "hallucination":
            return hallucination.signals(self.response, F.col("_lower_response"))
        if name == "pii":
            out = {f"pii_prompt_{k}": v
                   for k, v in pii.counts(self.prompt, c.pii_categories).items()}
            if c.details:
                found = pii.matches(self.response, c.pii_categories)
            else:
                found = pii.counts(self.response, c.pii_categories)
            return out | {f"pii_response_{k}": v for k, v in found.items()}
        if name == "prompt_injection":
            low, folded = F.col("_low_prompt"), F.col("_folded_prompt")
            found = (injection.matches(low, folded) if c.details
                     else injection.categories(folded))
            return {f"injection_{k}": v for k, v in found.items()}
        return {f"rules_{side}": self.rule_hits(side) for side in ("prompt", "response")}

    def sided_scores(self, name: str) -> dict[str, Column]:
        """Scores of evaluators that look at both sides."""
        c = self.config
        if name == "pii":
            kinds = pii.enabled(c.pii_categories)
            size = F.size if c.details else (lambda v: v)
            return {
                "pii_in_prompt": pii.score_of(pii.total_of(
                    {k: F.col(f"_pii_prompt_{k}") for k in kinds})),
                "pii_in_response": pii.score_of(pii.total_of(
                    {k: size(F.col(f"_pii_response_{k}")) for k in kinds}))}
        return {}

    def score(self, name: str) -> Column:
        n = self.names
        if name == "toxicity":
            return toxicity.score(F.col("_toxicity_input"), self.response)
        if name == "alignment":
            return alignment.score(self.prompt, self.response,
                                   self.optional(n.prompt_vector, "array<float>"),
                                   self.optional(n.response_vector, "array<float>"))
        if name == "hallucination":
            return hallucination.score_of({s: F.col(f"_{s}") for s in hallucination.SIGNALS})
        if name == "pii":
            return F.greatest("_pii_in_prompt", "_pii_in_response")
        if name == "prompt_injection":
            size = F.size if self.config.details else None
            return injection.score_of({
                k: size(F.col(f"_injection_{k}")) > 0 if size else F.col(f"_injection_{k}")
                for k in injection.CATEGORIES})
        return F.greatest(rules.score_of(F.col("_rules_prompt"), self.prompt_rules),
                          rules.score_of(F.col("_rules_response"), self.response_rules))

    def error(self, name: str) -> Column:
        """Error text of a model that gave no result for the row."""
        n = self.names
        column = {"toxicity": n.toxicity_error, "alignment": n.alignment_error}.get(name)
        return self.optional(column, "string") if column else F.lit(None).cast("string")

    def detail(self, name: str) -> tuple[Column, Column, Column]:
        """Score, detail struct and detected items. They are those of the response, of the
        prompt for prompt injection, and of the pair for alignment."""
        value = F.col(f"_{name}")
        if name == "toxicity":
            given = F.col("_toxicity_input")
            info = F.when(~T.is_blank(self.response), toxicity.detail(given))
            items = toxicity.detected_items(given, self.config.toxicity_threshold)
            return value, info, F.when(value > 0, items)
        if name == "alignment":
            nothing = F.array().cast("array<string>")
            return value, alignment.detail(value, self.prompt, self.response), nothing
        if name == "hallucination":
            info = hallucination.detail(self.response)
            return value, info, hallucination.detected_items(info)
        if name == "pii":
            info = pii.detail_of({k: F.col(f"_pii_response_{k}")
                                  for k in pii.enabled(self.config.pii_categories)})
            return F.col("_pii_in_response"), info, pii.detected_items(info)
        if name == "prompt_injection":
            info = injection.detail_of({k: F.col(f"_injection_{k}")
                                        for k in injection.CATEGORIES})
            return value, info, injection.detected_items(info)
        positions = F.col("_rules_response")
        info = rules.detail(self.response, positions, self.response_rules)
        return (rules.score_of(positions, self.response_rules), info,
                F.transform(info["triggered_rules"], lambda r: r["name"]))

    def result(self, name: str) -> Column:
        """One evaluator's part of ``detailed_results``."""
        value, info, items = self.detail(name)
        limit = F.lit(self.config.threshold(name))
        passed = value >= limit if name == "alignment" else value <= limit
        none = F.array().cast("array<string>")
        return F.struct(value.alias("score"), passed.alias("passed"), info.alias("details"),
                        F.coalesce(items, none).alias("detected_items"),
                        F.lit(1.0).alias("confidence"))

    # -- stages --

    def scored(self) -> DataFrame:
        """Scores ``_<evaluator>``; a fail-fast row has no score after its first flag."""
        out = self.df
        errors = {name: self.error(name) for name in self.config.enabled}
        running = F.lit(True)
        for name in self.config.enabled:
            guard = (lambda c: F.when(running, c)) if self.config.fail_fast else (lambda c: c)
            for stage in (self.prepared, self.matches, self.sided_scores):
                found = {f"_{k}": guard(c) for k, c in stage(name).items()}
                if found:
                    out = out.withColumns(found)
            value = guard(F.when(errors[name].isNull(), self.score(name)))
            out = out.withColumn(f"_{name}", value)
            flagged = exceeds(name, F.col(f"_{name}"), F.lit(self.config.threshold(name)))
            if self.config.fail_fast:
                # what is present: reached before any flag, and without a model error
                out = out.withColumn(f"_has_{name}", running & errors[name].isNull())
                out = out.withColumn(f"_on_{name}", running & ~flagged)
                running = F.col(f"_on_{name}")
        return out

    def is_kept(self, column: str) -> bool:
        """Whether flags, scores or details still need a column of ``scored``."""
        if column.startswith(("_has_", "_on_", "_pii_in_")):
            return True
        if column.removeprefix("_") in SCORE_KEYS:
            return True
        return self.config.details and (column == "_rules_response" or column.startswith(
            ("_toxicity_input", "_pii_response_", "_injection_")))

    def flags(self) -> Column:
        found = []
        for name in self.config.enabled:
            value = F.col(f"_{name}")
            in_prompt = (F.col("_pii_in_prompt") > F.col("_pii_in_response")
                         if name == "pii" else F.lit(False))
            flagged = exceeds(name, value, F.lit(self.config.threshold(name)))
            found.append(F.when(flagged, flag_text(name, value, in_prompt)))
        return T.keep_present(*found)

    def scores(self) -> Column:
        return scores_map(self.df, self.config, self.names)

    def metadata(self) -> Column:
        """Lengths, whether a context came along, the side with more personal data, and
        errors of the models."""
        context = self.optional(self.names.context, "string")
        fields = [F.length(self.prompt).alias("prompt_length"),
                  F.length(self.response).alias("response_length"),
                  context.isNotNull().alias("context_provided")]
        if "pii" in self.config.enabled:
            side = F.when(F.col("_pii_in_prompt") > F.col("_pii_in_response"), "prompt")
            fields.append(F.when(F.col("_pii") > 0, side.otherwise("response"))
                          .alias("pii_location"))
        for name in ("toxicity", "alignment"):
            if name in self.config.enabled:
                fields.append(self.error(name).alias(f"{name}_error"))
        return F.struct(*fields)

    def details(self) -> Column:
        shown = []
        for name in self.config.enabled:
            info = self.result(name)
            if self.config.fail_fast:
                info = F.when(F.col(f"_on_{name}"), info)
            if name in ("toxicity", "alignment"):
                info = F.when(self.error(name).isNull(), info)
            shown.append(info.alias(name))
        return F.struct(*shown)


def scores_map(df: DataFrame, config: EvalConfig, names: PairColumns) -> Column:
    """``MAP`` from score key to score, without the evaluators that gave none."""
    pairs = []
    for name in config.enabled:
        pairs += [F.lit(SCORE_KEYS[name]), F.col(f"_{name}")]
    if not pairs:
        return F.create_map().cast("map<string,double>")
    full = F.create_map(*pairs)
    gone = []
    for name in config.enabled:
        error = {"toxicity": names.toxicity_error, "alignment": names.alignment_error}.get(name)
        if config.fail_fast:
            gone.append(F.when(~F.col(f"_has_{name}"), F.lit(SCORE_KEYS[name])))
        elif error and error in df.columns:
            gone.append(F.when(F.col(error).isNotNull(), F.lit(SCORE_KEYS[name])))
    if not gone:
        return full
    absent = T.keep_present(*gone)
    return F.map_filter(full, lambda k, _: ~F.array_contains(absent, k))


def evaluate(df: DataFrame, config: EvalConfig = EvalConfig(), rule_list=(),
             names: PairColumns = PairColumns()) -> DataFrame:
    """Every input row with its result.

    Adds ``scores MAP``, ``flags ARRAY``, ``passed``, ``metadata STRUCT``, ``pair_key``,
    ``evaluation_id`` and, if the configuration asks for it, ``detailed_results STRUCT``.
    The operator is a projection: it moves no rows, in batch and in streams alike. Repartition a
    small table that is read by few tasks.
    """
    plan = _Plan(df, config, rule_list, names)
    out = plan.scored()
    private = [c for c in out.columns if c not in df.columns and plan.is_kept(c)]
    if private:
        out = compute_once(out, df.columns, private)
    out = out.withColumn("flags", plan.flags())
    added = {"scores": plan.scores(), "passed": F.size("flags") == 0,
             "metadata": plan.metadata(),
             "pair_key": hashing.pair_key(plan.prompt, plan.response)}
    if config.details:
        added["detailed_results"] = plan.details()
    out = out.withColumns(added)
    out = out.withColumn("evaluation_id",
                         hashing.evaluation_id(F.col(names.id), F.col("pair_key")))
    keep = [*df.columns, "evaluation_id", "pair_key", "scores", "flags", "passed", "metadata"]
    return out.select(*keep, *(["detailed_results"] if config.details else []))


def select_evaluators(df: DataFrame, evaluators: list[str], config: EvalConfig = EvalConfig(),
                      rule_list=(), names: PairColumns = PairColumns()) -> DataFrame:
    return evaluate(df, config.only(evaluators), rule_list, names)


def score_details(config: EvalConfig, scores: str = "scores") -> Column:
    """Per metric value, threshold and whether it passed."""
    thresholds = F.create_map(*[part for name, key in SCORE_KEYS.items()
                                for part in (F.lit(key), F.lit(config.threshold(name)))])

    def one(entry):
        value, limit = entry["value"], thresholds[entry["key"]]
        passed = F.when(entry["key"] == "alignment", value >= limit).otherwise(value <= limit)
        return F.struct(entry["key"].alias("key"), F.struct(
            value.alias("value"), limit.alias("threshold"), passed.alias("passed")).alias("value"))

    return F.map_from_entries(F.transform(F.map_entries(scores), one))


def apply_api_rules(df: DataFrame, rule_list, names: PairColumns = PairColumns()) -> DataFrame:
    """Rules on top of an evaluation: any violation fails the pair, ``flag`` ones are shown.

    Violations of the prompt come before those of the response. Rules without a pattern
    never fire here, and rules do look at empty texts.
    """
    active = [r for r in rules.usable(df.sparkSession, rule_list) if r.pattern]
    out, sides = df, []
    for column, target in ((names.prompt, "prompt"), (names.response, "response")):
        mine = rules.for_target(active, target)
        out = rules.add_hits(out, column, mine, f"_{target}_hits", on_empty=True)
        sides.append(rules.violations(F.col(f"_{target}_hits"), mine))
    out = out.withColumn("rule_violations", F.concat(*sides)).select(
        *df.columns, "rule_violations")
    shown = F.transform(F.filter("rule_violations", lambda v: v["action"] == "flag"),
                        lambda v: F.concat(F.lit("Custom rule violation: "), v["name"]))
    return out.withColumns({
        "flags": F.concat("flags", shown),
        "passed": F.col("passed") & (F.size("rule_violations") == 0),
        "custom_rule_violations": F.size("rule_violations")})
