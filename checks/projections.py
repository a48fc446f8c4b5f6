"""Checks of row-wise operators (B1-B12) and sources and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import base as B
from checks import sql as S
from checks.planting import quoted
from checks.registry import check
from wardspark.functions import patterns as P
from wardspark.functions import text as T
from wardspark.operators import projections as R
from wardspark.operators import report
from wardspark.session import scratch_path
from wardspark.sources import pairs, results, rules

_VALID_TEXT = """CASE WHEN doc_id % 5 = 0 THEN text || text || text || text || text || text
  ELSE '  ' || chr(160) || text || chr(10) END"""


@check("validate_pairs", f"""
WITH {B.TEXTS}, t AS (SELECT doc_id, {_VALID_TEXT} AS prompt, text AS response FROM texts)
SELECT doc_id, CASE WHEN length(prompt) = 0 THEN 'prompt is empty' WHEN length(prompt) > 50000
  THEN 'prompt is too long' WHEN length(response) = 0 THEN 'response is empty'
  WHEN length(response) > 100000 THEN 'response is too long' END AS reject_reason,
  sha256(regexp_replace(prompt, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS prompt_hash,
  length(regexp_replace(response, '^\\s+|\\s+$', '', 'g')) AS response_length FROM t""")
def _(spark, sf):
    t = F.col("text")
    rows = B.texts(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.repeat(t, 6))
        .otherwise(F.concat(F.lit("   "), t, F.lit("\n"))).alias("prompt"), t.alias("response"))
    out = R.validate_pairs(rows)
    return out.select("doc_id", "reject_reason", F.sha2("prompt", 256).alias("prompt_hash"),
                      F.length("response").alias("response_length"))


@check("pair_metadata", f"""
WITH {B.PAIRS} SELECT id, length(prompt) AS prompt_length, length(response) AS response_length,
  turn > 2 AS context_provided FROM pairs""")
def _(spark, sf):
    rows = B.pairs(spark, sf).withColumn("context", F.when(F.col("turn") > 2, F.col("id")))
    return R.pair_metadata(rows).select("id", "prompt_length", "response_length",
                                        "context_provided")


def _status_sql(scheme: str) -> str:
    cases = []
    strict = scheme == "report"
    for name, (good, fair) in (R.STATUS_REPORT if strict else R.STATUS_CARDS).items():
        if name == "alignment":
            a, sign, b = "green", ">" if strict else ">=", "red"
            order = ((good, a), (fair, "orange"))
        elif strict:
            a, sign, b = "red", ">", "green"
            order = ((fair, a), (good, "orange"))
        else:
            a, sign, b = "green", "<=", "red"
            order = ((good, a), (fair, "orange"))
        whens = " ".join(f"WHEN value {sign} {x}::DOUBLE THEN '{c}'" for x, c in order)
        cases.append(f"WHEN '{name}' THEN CASE {whens} ELSE '{b}' END")
    other = ("'blue'" if strict else
             "CASE WHEN value >= 0.5::DOUBLE THEN 'green' WHEN value >= 0.3::DOUBLE THEN 'orange' "
             "ELSE 'red' END")
    return f"CASE metric {' '.join(cases)} ELSE {other} END"


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id, '{B.KEYS[n]}' AS metric, {n} AS value FROM evaluated" for n in B.SCORES) + ")"


@check("metric_status", f"""
{B.EVALUATED}, {_LONG} SELECT id, metric, {_status_sql('report')} AS report,
  {_status_sql('cards')} AS cards FROM long""")
def _(spark, sf):
    rows = B.evaluated(spark, sf).select("id", F.explode("scores").alias("metric", "value"))
    m, v = F.col("metric"), F.col("value")
    return rows.select("id", "metric", R.metric_status(m, v, "report").alias("report"),
                       R.metric_status(m, v, "cards").alias("cards"))


@check("safety_normalise", f"""
{B.EVALUATED}, {_LONG} SELECT id, metric, round(CASE WHEN metric IN ('toxicity',
  'hallucination_risk', 'pii_risk', 'prompt_injection_risk') THEN 1.0::DOUBLE - value
  ELSE value END, 6) AS value FROM long""")
def _(spark, sf):
    out = B.evaluated(spark, sf).select("id", F.explode(R.safety_normalise(F.col("scores")))
                                        .alias("metric", "value"))
    return out.select("id", "metric", B.six("value").alias("value"))


_ADVICE_SQL = ", ".join(
    f"CASE WHEN {n} {sign} {bound}::DOUBLE THEN {quoted(sentence)} END"
    for n, (_, _, sign, bound, sentence) in zip(["tox", "ali", "hal", "pii", "inj"], R.ADVICE))


@check("recommendations", f"""
{B.EVALUATED} SELECT id, array_to_string(CASE WHEN len(flags) = 0
  THEN [{', '.join(map(quoted, R.ADVICE_PASSED))}]
  ELSE list_filter([{_ADVICE_SQL}], lambda x: x IS NOT NULL) END, ' | ') AS advice
FROM evaluated""")
def _(spark, sf):
    out = B.evaluated(spark, sf)
    return out.select("id", F.array_join(R.recommendations(F.col("scores"), F.col("passed")),
                                         " | ").alias("advice"))


_TITLES = {"tox": "Toxicity", "ali": "Alignment", "hal": "Hallucination Risk", "pii": "Pii Risk",
           "inj": "Prompt Injection Risk", "rul": "Custom Rules"}
_SCORE_LINES = " || chr(10) || ".join(
    f"(SELECT '- ' || CASE c WHEN 'green' THEN '🟢' WHEN 'orange' THEN '🟡' ELSE '🔴' END || ' **"
    f"{_TITLES[n]}**: ' || printf('%.3f', value) FROM (SELECT value, {_status_sql('report')} AS c "
    f"FROM (SELECT '{B.KEYS[n]}' AS metric, {n} AS value)))"
    for n in sorted(B.SCORES, key=B.KEYS.get))
_BULLETS = "array_to_string(list_transform({}, lambda x: '- ' || x), chr(10))"


@check("report_rows", f"""
{B.EVALUATED} SELECT id, concat_ws(chr(10), '# Evaluation Report', '',
  '**Generated**: 2024-02-01 00:00:00', '', '## Input', '', '### Prompt', '```', prompt, '```',
  '### Response', '```', response, '```', '## Evaluation Results', '',
  '**Overall Status**: ' || CASE WHEN len(flags) = 0 THEN 'PASSED' ELSE 'FAILED' END, '',
  '### Scores', {_SCORE_LINES}, '', CASE WHEN len(flags) > 0 THEN '### Issues Detected' || chr(10)
  || {_BULLETS.format('flags')} ELSE '### No Issues Detected' END, '',
  '## Detailed Analysis', '- Words: ' || {S.words('response')}, '',
  '## Recommendations', {_BULLETS.format(f"""CASE WHEN len(flags) = 0
  THEN [{', '.join(map(quoted, R.ADVICE_PASSED))}]
  ELSE list_filter([{_ADVICE_SQL}], lambda x: x IS NOT NULL) END""")}) AS report
FROM evaluated""")
def _(spark, sf):
    words = F.concat(F.lit("Words: "), T.word_count(F.col("response")).cast("string"))
    out = report.report_rows(B.evaluated(spark, sf), "2024-02-01 00:00:00", F.array(words))
    return out.select("id", "report")


def _section_sql(title: str, body: str) -> str:
    return f"'### {title}' || chr(10) || {body}"


def _joined_sql(parts: list[str], sep: str) -> str:
    return f"nullif(concat_ws({sep}, {', '.join(parts)}), '')"


_PII_SECTION = _joined_sql([
    f"CASE WHEN {S.pii_count('response', c)} > 0 THEN '- **{c.replace('_', ' ').title()}**: ' || "
    f"{S.pii_count('response', c)} || ' found' END" for c in P.PII_PATTERNS], "chr(10)")
_INJECTION_FOUND = _joined_sql([
    f"CASE WHEN len({S.injection_matches('prompt', c)}) > 0 THEN '{c}' END"
    for c in P.INJECTION_PATTERNS], "', '")
_PHRASES = {"Uncertainty Phrases": P.UNCERTAINTY, "Overconfidence Phrases": P.OVERCONFIDENCE,
            "Fabrication Indicators": P.FABRICATION}
_PHRASE_ROWS = _joined_sql([
    f"CASE WHEN {S.lexicon_hits('lower(response)', w)} > 0 THEN '| {t} | ' || "
    f"{S.lexicon_hits('lower(response)', w)} || ' |' END" for t, w in _PHRASES.items()], "chr(10)")
_PHRASE_SECTION = f"'| Indicator | Found |' || chr(10) || '|---|---|' || chr(10) || {_PHRASE_ROWS}"


@check("report_sections", f"""
{B.EVALUATED} SELECT id, {_section_sql('Pii', _PII_SECTION)} AS pii_section,
  {_section_sql('Prompt Injection', _INJECTION_FOUND)} AS injection_section,
  {_section_sql('Hallucination', _PHRASE_SECTION)} AS hallucination_section,
  CASE WHEN NOT {S.blank('response')} THEN concat_ws(chr(10), '### Toxicity',
    '| Category | Score |', '|---|---|', '| Toxicity | ' || printf('%.3f', tox_1) || ' |',
    '| Insult | ' || printf('%.3f', tox_2) || ' |') END AS toxicity_section FROM evaluated""")
def _(spark, sf):
    """The sections of four evaluators, cut out of those of the whole report."""
    found = B.evaluated(spark, sf, replace(B.FULL, details=True))
    parted = found.select("id", F.split(report.sections(found), r"\n(?=### )").alias("parts"))

    def one(title):
        return F.get(F.filter("parts", lambda x: x.startswith("### " + title)), 0)

    return parted.select(
        "id", one("Pii").alias("pii_section"),
        F.regexp_replace(one("Prompt Injection"), r"- \*\*Detected patterns\*\*: (.*)\n.*", "$1")
        .alias("injection_section"),
        one("Hallucination").alias("hallucination_section"),
        one("Toxicity").alias("toxicity_section"))


@check("pairs_from_conversations", f"""
WITH {B.PAIRS} SELECT conv_id || '-' || turn AS id, prompt, response FROM raw_pairs
WHERE role = 'user' AND next_role = 'assistant'""")
def _(spark, sf):
    out = pairs.pairs_from_conversations(B.table(spark, sf, "conversations"))
    return out.select("id", "prompt", "response")


_TEXT_PAIRS = (f"WITH {B.PAIRS} SELECT id, prompt, response, {{extra}} FROM pairs")


@check("read_pairs_csv", f"""
WITH {B.PAIRS} SELECT id, CASE WHEN prompt = '' THEN NULL ELSE prompt END AS prompt,
  CASE WHEN response = '' THEN NULL ELSE response END AS response FROM pairs""")
def _(spark, sf):
    """All pairs through a CSV file, texts with quotes and line ends included."""
    path = scratch_path(spark, "pairs-csv")
    B.pairs(spark, sf).select("id", "prompt", "response").write.csv(
        path, **results.CSV_OPTIONS)
    return pairs.read_pairs_csv(spark, path, id_col="id")


@check("read_pairs_csv_numbered", f"""
WITH {B.PAIRS} SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, prompt_hash FROM
  (SELECT conv_id, turn, sha256(CASE WHEN prompt = '' THEN NULL ELSE prompt END) AS prompt_hash
   FROM pairs)""")
def _(spark, sf):
    """Row numbers over several files in order."""
    path = scratch_path(spark, "pairs-csv")
    B.pairs(spark, sf).orderBy("conv_id", "turn").select("prompt", "response").write.csv(
        path, **results.CSV_OPTIONS)
    return pairs.read_pairs_csv(spark, path).select("id", F.sha2("prompt", 256)
                                                    .alias("prompt_hash"))


@check("read_pairs_json", f"""
WITH {B.PAIRS}, numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM pairs)
SELECT CASE WHEN turn = 0 THEN 'item_' || substr(sha256(n || '|' || strlen(prompt) || ':' || prompt
  || strlen(response) || ':' || response), 1, 24) ELSE id END AS id, prompt, response,
  CASE WHEN turn > 2 THEN id END AS context, conv_id::VARCHAR AS conversation FROM numbered""")
def _(spark, sf):
    """Every first turn without an id of its own."""
    path = scratch_path(spark, "pairs-json")
    p = B.pairs(spark, sf).orderBy("conv_id", "turn")
    p.select(F.when(F.col("turn") != 0, F.col("id")).alias("id"), "prompt", "response",
             F.when(F.col("turn") > 2, F.col("id")).alias("context"),
             F.create_map(F.lit("conversation"), F.col("conv_id").cast("string"))
             .alias("metadata")).write.json(path)
    out = pairs.read_pairs_json(spark, path)
    return out.select("id", "prompt", "response", "context",
                      F.col("metadata")["conversation"].alias("conversation"))


@check("write_results_csv", f"""
{B.EVALUATED} SELECT id, len(flags) = 0 AS passed, len(flags) AS flags_count,
  nullif(array_to_string(flags, '; '), '') AS flags,
  {', '.join(f'round({n}, 6) AS {B.KEYS[n]}' for n in B.SCORES)} FROM evaluated""")
def _(spark, sf):
    path = scratch_path(spark, "results-csv")
    results.write_results_csv(B.evaluated(spark, sf), path)
    out = spark.read.csv(path, header=True, escape='"', schema=(
        "id string, passed boolean, flags_count int, flags string, "
        + ", ".join(f"{B.KEYS[n]} double" for n in B.SCORES)))
    return out.select("id", "passed", "flags_count", "flags",
                      *[B.six(B.KEYS[n]).alias(B.KEYS[n]) for n in B.SCORES])


@check("write_results_json", f"""
{B.EVALUATED} SELECT evaluation_id, round(hal, 6) AS hallucination_risk, round(tox, 6) AS tox,
  len(flags) = 0 AS passed, coalesce(flags[1], '') AS first_flag,
  length(prompt) AS prompt_length FROM evaluated""")
def _(spark, sf):
    """The documents themselves, taken apart by JSON path."""
    path = scratch_path(spark, "results-json")
    rows = B.evaluated(spark, sf).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    results.write_results_json(rows, path)

    def at(p, kind):
        return F.get_json_object("value", f"$.{p}").cast(kind)

    return spark.read.text(path).select(
        at("evaluation_id", "string").alias("evaluation_id"),
        B.six(at("scores.hallucination_risk", "double")).alias("hallucination_risk"),
        B.six(at("scores.toxicity", "double")).alias("tox"), at("passed", "boolean").alias("passed"),
        F.coalesce(at("flags[0]", "string"), F.lit("")).alias("first_flag"),
        at("metadata.prompt_length", "int").alias("prompt_length"))


@check("read_results_json", f"""
{B.EVALUATED} SELECT evaluation_id, CASE WHEN turn <> 2 THEN '2024-01-01 10:20:30.500000' END
  AS "timestamp", CASE WHEN turn = 4 THEN 0 ELSE 6 END AS n_scores,
  CASE WHEN turn = 4 THEN NULL ELSE round(hal, 6) END AS hal,
  CASE WHEN turn = 2 THEN '' ELSE array_to_string(flags, ' | ') END AS flags,
  turn = 0 OR len(flags) = 0 AS passed FROM evaluated""")
def _(spark, sf):
    """Full documents and documents with parts left out."""
    path = scratch_path(spark, "results-json")
    rows = B.evaluated(spark, sf)
    turn = F.col("turn")
    at = F.lit("2024-01-01 10:20:30.5").cast("timestamp")
    rows = rows.withColumns({
        "timestamp": F.when(turn != 2, at), "flags": F.when(turn != 2, F.col("flags")),
        "scores": F.when(turn != 4, F.col("scores")),
        "passed": F.when(turn != 0, F.col("passed"))})
    results.write_results_json(rows, path)
    out = results.read_results_json(spark, path)
    return out.select("evaluation_id", B.stamp("timestamp"), F.size("scores").alias("n_scores"),
                      B.six(F.col("scores")["hallucination_risk"]).alias("hal"),
                      F.array_join("flags", " | ").alias("flags"), "passed")


_RULE_ROWS = """known AS (SELECT 'src-' || source AS rule_id, min(lang) AS pattern
  FROM documents GROUP BY source),
fresh AS (SELECT 'src-' || source AS rule_id, 'x' AS pattern FROM documents
  UNION SELECT 'lang-' || lang, 'y' FROM documents)"""


@check("read_rules", f"""
WITH {_RULE_ROWS} SELECT rule_id, pattern, 'keyword' AS rule_type, 0.5::DOUBLE AS severity,
  'flag' AS action, 'both' AS apply_to, TRUE AS enabled FROM known
UNION ALL SELECT DISTINCT rule_id, pattern, 'regex', 0.9::DOUBLE, 'block', 'prompt', FALSE
FROM fresh WHERE rule_id NOT IN (SELECT rule_id FROM known)""")
def _(spark, sf):
    """Rules made from sources and languages: written, read back, and appended to."""
    documents = B.table(spark, sf, "documents")
    known = (documents.groupBy("source").agg(F.min("lang").alias("pattern"))
             .select(F.concat(F.lit("src-"), "source").alias("id"),
                     F.col("source").alias("name"), "pattern", F.lit("keyword").alias("type")))
    path = scratch_path(spark, "rules")
    known.write.json(path)
    ids = documents.select(F.concat(F.lit("src-"), "source").alias("rule_id"),
                           F.lit("x").alias("pattern")).unionByName(
        documents.select(F.concat(F.lit("lang-"), "lang").alias("rule_id"),
                         F.lit("y").alias("pattern")))
    new = ids.select("rule_id", F.col("rule_id").alias("name"), "pattern",
                     F.lit("regex").alias("rule_type"), F.lit(0.9).alias("severity"),
                     F.lit("block").alias("action"), F.lit("prompt").alias("apply_to"),
                     F.lit(False).alias("enabled"))
    out = rules.append_rules(rules.read_rules(spark, path), new)
    again = scratch_path(spark, "rules")
    rules.write_rules(out, again)
    return rules.read_rules(spark, again).drop("name")


@check("append_evaluations", f"""
{B.LOG} SELECT evaluation_id, sha256(prompt) AS prompt_hash, sha256(response) AS response_hash,
  passed, latency_ms, source, strftime("timestamp", '%Y-%m-%d') AS dt FROM log""")
def _(spark, sf):
    """The whole log, appended in two parts and read back by partition."""
    path = scratch_path(spark, "evaluations")
    rows = B.log(spark, sf)
    early = F.col("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    results.append_evaluations(rows.filter(early), path)
    results.append_evaluations(rows.filter(~early), path)
    return results.read_log(spark, path).select(
        "evaluation_id", "prompt_hash", "response_hash", "passed", "latency_ms", "source",
        F.date_format("dt", "yyyy-MM-dd").alias("dt"))
