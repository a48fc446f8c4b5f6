"""Checks of whole evaluations and batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import base as B
from checks import sql as S
from checks.registry import check
from wardspark.config import SCORE_KEYS, EvalConfig
from wardspark.functions import patterns as P
from wardspark.plans import batch, cache
from wardspark.plans import evaluate as ev
from wardspark.session import scratch_path
from wardspark.sources.results import CSV_OPTIONS



def _flags():
    return F.array_join("flags", " | ").alias("flags")


_FLAGS_SQL = "array_to_string(flags, ' | ') AS flags"


@check("evaluate", f"""
{B.EVALUATED} SELECT id, evaluation_id, pair_key, {B.FLAT}, {_FLAGS_SQL}, len(flags) = 0 AS passed
FROM evaluated""")
def _(spark, sf):
    out = B.evaluated(spark, sf)
    return out.select("id", "evaluation_id", "pair_key", *B.flat_scores(out), _flags(), "passed")


_DEFAULT = EvalConfig()


@check("flags", f"""
{B.evaluated_sql(_DEFAULT)} SELECT id, unnest(flags) AS flag FROM evaluated""")
def _(spark, sf):
    """Flags under the default configuration, one per row."""
    return B.evaluated(spark, sf, _DEFAULT).select("id", F.explode("flags").alias("flag"))


@check("passed", f"""
{B.EVALUATED} SELECT len(flags) = 0 AS passed, count(*) AS n FROM evaluated GROUP BY ALL""")
def _(spark, sf):
    return B.evaluated(spark, sf).groupBy("passed").agg(F.count("*").alias("n"))


def _fail_fast_sql() -> str:
    """A score is present when no earlier one was flagged."""
    shown, before = [], "FALSE"
    for n in B.SCORES:
        shown.append(f"CASE WHEN NOT ({before}) THEN round({n}, 6) END AS {n}")
        before += f" OR ({B.flag_sql(n)}) IS NOT NULL"
    return (f"{B.EVALUATED} SELECT id, {', '.join(shown)}, "
            "coalesce(flags[1], '') AS flags, len(flags) = 0 AS passed FROM evaluated")


@check("fail_fast", _fail_fast_sql())
def _(spark, sf):
    out = B.evaluated(spark, sf, replace(B.FULL, fail_fast=True))
    return out.select("id", *B.flat_scores(out), _flags(), "passed")


@check("fail_fast_details", f"""
{B.EVALUATED}, f AS (SELECT id, response, prompt, {', '.join(
    f'({B.flag_sql(n)}) IS NOT NULL AS f_{n}' for n in B.SCORES)} FROM evaluated)
SELECT id, NOT f_tox AS has_toxicity, NOT (f_tox OR f_ali OR f_hal) AS has_hallucination,
  NOT (f_tox OR f_ali OR f_hal OR f_pii) AS has_pii,
  NOT (f_tox OR f_ali OR f_hal OR f_pii OR f_inj) AS has_prompt_injection,
  NOT (f_tox OR f_ali OR f_hal OR f_pii OR f_inj OR f_rul) AS has_custom_rules FROM f""")
def _(spark, sf):
    """Details end with the first flag; those of the flagged evaluator are left out."""
    out = B.evaluated(spark, sf, replace(B.FULL, fail_fast=True, details=True))
    return out.select("id", *[F.col("detailed_results")[n].isNotNull().alias(f"has_{n}")
                              for n in SCORE_KEYS if n != "alignment"])


@check("details", f"""
{B.EVALUATED} SELECT id, CASE WHEN {S.blank('response')} THEN NULL WHEN tox_1 >= tox_2
  THEN 'toxicity' ELSE 'insult' END AS max_category, pii_r AS pii_response_score,
  array_to_string(list_filter([{', '.join(
      f"CASE WHEN {S.pii_count('response', c)} > 0 THEN '{c}: ' || {S.pii_count('response', c)} "
      "|| ' found' END" for c in P.PII_PATTERNS)}], lambda x: x IS NOT NULL), '|') AS pii_items,
  inj <= 0.5::DOUBLE AS injection_passed,
  {S.lexicon_list('lower(response)', P.UNCERTAINTY)} AS uncertainty_phrases,
  {S.words('response')} AS word_count, pii_r_n AS pii_matches,
  {' + '.join(f"len({S.injection_matches('prompt', c)})" for c in P.INJECTION_PATTERNS)}
    AS injection_matches,
  array_to_string({S.rule_ids('response', B.RULES, 'response')}, '|') AS response_rules,
  CASE WHEN ali >= 0.8::DOUBLE THEN 'high' WHEN ali >= 0.5::DOUBLE THEN 'moderate'
    WHEN ali >= 0.3::DOUBLE THEN 'low' ELSE 'very_low' END AS alignment_level,
  {B.FLAT}, {_FLAGS_SQL} FROM evaluated""")
def _(spark, sf):
    """Details come from the response, those of prompt injection from the prompt."""
    out = B.evaluated(spark, sf, replace(B.FULL, details=True))
    d = F.col("detailed_results")
    return out.select(
        "id", d["toxicity"]["details"]["max_category"].alias("max_category"),
        F.array_join(d["hallucination"]["details"]["uncertainty_phrases"], "|")
        .alias("uncertainty_phrases"),
        d["hallucination"]["details"]["word_count"].alias("word_count"),
        d["pii"]["details"]["total_matches"].alias("pii_matches"),
        d["pii"]["score"].alias("pii_response_score"),
        F.array_join(d["pii"]["detected_items"], "|").alias("pii_items"),
        d["prompt_injection"]["details"]["total_patterns_matched"].alias("injection_matches"),
        d["prompt_injection"]["passed"].alias("injection_passed"),
        F.array_join(d["custom_rules"]["details"]["triggered_rules"]["rule_id"], "|")
        .alias("response_rules"),
        d["alignment"]["details"]["alignment_level"].alias("alignment_level"),
        *B.flat_scores(out), _flags())


@check("error_isolation", f"""
{B.EVALUATED}, e AS (SELECT *, turn % 4 = 2 AS broken FROM evaluated)
SELECT id, CASE WHEN broken THEN 'no result' END AS toxicity_error,
  CASE WHEN NOT broken THEN round(tox, 6) END AS tox, round(hal, 6) AS hal,
  broken AS toxicity_absent,
  array_to_string(list_filter(flags, lambda f: NOT broken OR NOT starts_with(f, 'High toxicity')),
    ' | ') AS flags FROM e""")
def _(spark, sf):
    """A model that fails on some rows leaves no score there; the others go on."""
    broken = F.col("turn") % 4 == 2
    rows = B.with_vectors(spark, sf).withColumn("toxicity_error", F.when(broken, "no result"))
    out = ev.evaluate(rows, B.FULL, B.RULES)
    return out.select("id", "metadata.toxicity_error", *B.flat_scores(out)[:1],
                      *B.flat_scores(out)[2:3],
                      (~F.array_contains(F.map_keys("scores"), "toxicity"))
                      .alias("toxicity_absent"), _flags())


_NAMES = dict(zip(B.SCORES, SCORE_KEYS))


@check("score_details", f"{B.EVALUATED} " + " UNION ALL ".join(
    f"SELECT id, '{B.KEYS[n]}' AS metric, round({n}, 6) AS value, "
    f"{B.FULL.threshold(_NAMES[n])}::DOUBLE AS threshold, "
    f"{n} {'>=' if n == 'ali' else '<='} {B.FULL.threshold(_NAMES[n])}::DOUBLE AS passed "
    "FROM evaluated" for n in B.SCORES))
def _(spark, sf):
    out = B.evaluated(spark, sf)
    return (out.select("id", F.explode(ev.score_details(B.FULL)).alias("metric", "d"))
            .select("id", "metric", B.six("d.value").alias("value"), "d.threshold", "d.passed"))


def _shown(column: str, target: str) -> str:
    names = [f"CASE WHEN {S.rule_fires(column, r)} THEN 'Custom rule violation: {r.name}' END"
             for r in S.active(B.RULES, target) if r.action == "flag"]
    return f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)"


def _fired(column: str, target: str) -> str:
    return " + ".join(f"({S.rule_fires(column, r)})::INT" for r in S.active(B.RULES, target))


@check("apply_api_rules", f"""
{B.evaluated_sql(_DEFAULT)}, r AS (SELECT id, flags AS own,
  list_concat({_shown('prompt', 'prompt')}, {_shown('response', 'response')}) AS added,
  {_fired('prompt', 'prompt')} + {_fired('response', 'response')} AS custom_rule_violations
  FROM evaluated)
SELECT id, array_to_string(list_concat(own, added), ' | ') AS flags, custom_rule_violations,
  len(own) = 0 AND custom_rule_violations = 0 AS passed FROM r""")
def _(spark, sf):
    out = ev.apply_api_rules(B.evaluated(spark, sf, _DEFAULT), B.RULES)
    return out.select("id", _flags(), "custom_rule_violations", "passed")


_SOME_CACHED = B.FULL.only(["hallucination", "pii", "prompt_injection", "custom_rules"])
_COPIES = ("copies AS (SELECT id || '#' || copy AS id, conv_id, turn, prompt, response, tox_1, "
           "tox_2 FROM pairs, (SELECT unnest([1, 2, 3]) AS copy))")


@check("dedup_evaluate", f"""
WITH {B.PAIRS}, {_COPIES.replace('copies AS', 'originals AS')},
{B.VECTORS.replace('FROM pairs p', 'FROM originals p')}, {B.RAW_SCORES},
evaluated AS (SELECT *, {B.flags_sql()} AS flags,
  'eval_' || substr(sha256('|' || pair_key), 1, 24) AS evaluation_id FROM scored)
SELECT id, evaluation_id, pair_key, hal_, flags, passed FROM (SELECT id, evaluation_id, pair_key,
  round(hal, 6) AS hal_, {_FLAGS_SQL}, len(flags) = 0 AS passed FROM evaluated)""")
def _(spark, sf):
    """Three copies of every pair share one result."""
    copies = F.explode(F.array(*[F.lit(str(i)) for i in (1, 2, 3)]))
    rows = B.with_vectors(spark, sf).withColumn("copy", copies)
    rows = rows.withColumn("id", F.concat_ws("#", "id", "copy"))
    # copies of one pair have one model result
    out = batch.dedup_evaluate(rows.drop("conv_id", "turn", "copy"), B.FULL, B.RULES)
    return out.select("id", "evaluation_id", "pair_key",
                      B.six(F.col("scores")["hallucination_risk"]).alias("hal_"), _flags(), "passed")


@check("evaluate_cached", f"""
{B.evaluated_sql(_SOME_CACHED)}, runs AS (SELECT conv_id % 3 AS part, prompt, response FROM evaluated)
SELECT id, {_FLAGS_SQL}, round(hal, 6) AS hal, len(flags) = 0 AS passed,
  (SELECT count(*) FROM (SELECT DISTINCT prompt, response FROM runs WHERE part < 2)) AS after_first,
  (SELECT count(*) FROM (SELECT DISTINCT prompt, response FROM runs)) AS after_second,
  (SELECT count(*) FROM (SELECT DISTINCT prompt, response FROM runs)) AS after_third FROM evaluated""")
def _(spark, sf):
    """Two thirds of the conversations, then all, then all again: the pairs stored after each run."""
    store = cache.ResultCache(spark, scratch_path(spark, "results"), 8)
    rows, stored = B.pairs(spark, sf), []
    for part in (rows.filter("conv_id % 3 < 2"), rows, rows):
        out = cache.evaluate_cached(part, store, _SOME_CACHED, B.RULES)
        stored.append(store.size(_SOME_CACHED, B.RULES))
    return out.select("id", _flags(), B.six(F.col("scores")["hallucination_risk"]).alias("hal"), "passed", *[
        F.lit(n).cast("long").alias(f"after_{k}") for n, k in zip(stored, ("first", "second", "third"))])


@check("evaluate_batch", f"""
{B.EVALUATED} SELECT conv_id, turn, {_FLAGS_SQL}, len(flags) = 0 AS passed FROM evaluated""")
def _(spark, sf):
    out = batch.evaluate_batch(B.with_vectors(spark, sf), "turn", B.FULL, B.RULES)
    return out.select("conv_id", "turn", _flags(), "passed")


_NO_MODELS = EvalConfig(toxicity=False, alignment=False, pii=True, prompt_injection=True)


@check("evaluate_file", f"""
{B.evaluated_sql(_NO_MODELS)} SELECT id, len(flags) = 0 AS passed, len(flags) AS flags_count,
  round(hal, 6) AS hallucination_risk, round(pii, 6) AS pii_risk,
  (SELECT count(*) FILTER (len(flags) > 0) FROM evaluated) AS all_failed FROM evaluated""")
def _(spark, sf):
    """All pairs through CSV files, in and out."""
    source, target = scratch_path(spark, "pairs-csv"), scratch_path(spark, "results-csv")
    B.pairs(spark, sf).select("id", "prompt", "response").write.csv(source, **CSV_OPTIONS)
    summary = batch.evaluate_file(spark, source, target, _NO_MODELS, id_col="id")
    rows = spark.read.csv(target, header=True)
    return rows.select("id", F.col("passed").cast("boolean").alias("passed"),
                       F.col("flags_count").cast("int").alias("flags_count"),
                       *[B.six(F.col(c).cast("double")).alias(c)
                         for c in ("hallucination_risk", "pii_risk")],
                       summary.select("failed").scalar().alias("all_failed"))


@check("batch_fail_fast", f"""
{B.EVALUATED}, b AS (SELECT id, conv_id, turn, len(flags) = 0 AS passed FROM evaluated)
SELECT id, passed FROM b WHERE turn <= coalesce(
  (SELECT min(turn) FROM b f WHERE f.conv_id = b.conv_id AND NOT f.passed), turn)""")
def _(spark, sf):
    """Each conversation is a batch in turn order."""
    out = batch.batch_fail_fast(B.evaluated(spark, sf), "conv_id", "turn")
    return out.select("id", "passed")


@check("evaluate_until_failure", f"""
{B.EVALUATED}, b AS (SELECT id, conv_id, turn, len(flags) = 0 AS passed FROM evaluated)
SELECT id, passed FROM b WHERE turn <= coalesce(
  (SELECT min(turn) FROM b f WHERE f.conv_id = b.conv_id AND NOT f.passed), turn)""")
def _(spark, sf):
    """The same rows by waves: a conversation that has failed is evaluated no further."""
    out = batch.evaluate_until_failure(B.with_vectors(spark, sf), "conv_id", "turn", B.FULL, B.RULES,
                                       first_wave=3)
    return out.select("id", "passed")


@check("batch_summary", f"""
{B.EVALUATED}, b AS (SELECT conv_id, len(flags) = 0 AS passed, turn % 8 = 6 AS bad FROM evaluated)
SELECT conv_id, count(*) AS total, count(*) FILTER (NOT bad AND passed) AS passed_count,
  count(*) FILTER (NOT bad AND NOT passed) AS failed_count,
  count(*) FILTER (bad) AS error_count FROM b GROUP BY conv_id""")
def _(spark, sf):
    out = B.evaluated(spark, sf).withColumn(
        "error", F.when(F.col("turn") % 8 == 6, "too long"))
    return batch.batch_summary(out, "conv_id", "error")


_SETS = {
    "default": B.FULL,
    "strict": replace(B.FULL, toxicity_threshold=0.3, alignment_threshold=0.8),
    "lenient": replace(B.FULL, toxicity_threshold=0.9, alignment_threshold=0.2),
    "no_pii": replace(B.FULL, pii=False),
}


@check("threshold_compare", f"{B.EVALUATED}, sets AS (" + " UNION ALL ".join(
    f"SELECT id, '{label}' AS config, {B.flags_sql(c)} AS flags FROM scored"
    for label, c in _SETS.items())
    + f") SELECT id, config, {_FLAGS_SQL}, len(flags) = 0 AS passed FROM sets")
def _(spark, sf):
    out = batch.threshold_compare(B.evaluated(spark, sf), _SETS, ["id"])
    return out.select("id", "config", _flags(), "passed")


_SOME = B.FULL.only(["pii", "hallucination"])


@check("select_evaluators", f"""
{B.evaluated_sql(_SOME)} SELECT id, 'hallucination_risk,pii_risk' AS present,
  round(hal, 6) AS hal, round(pii, 6) AS pii, {_FLAGS_SQL} FROM evaluated""")
def _(spark, sf):
    out = ev.select_evaluators(B.pairs(spark, sf), ["pii", "hallucination"], B.FULL)
    return out.select("id", F.array_join(F.map_keys("scores"), ",").alias("present"),
                      B.six(F.col("scores")["hallucination_risk"]).alias("hal"),
                      B.six(F.col("scores")["pii_risk"]).alias("pii"), _flags())
