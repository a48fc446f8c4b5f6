"""Checks of the single evaluators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import base as B
from checks import sql as S
from checks.registry import check
from wardspark.functions import patterns as P
from wardspark.functions import text as T
from wardspark.operators import alignment, hallucination, injection, pii, registry, rules, toxicity

_LOW = "lower(text)"


@check("hallucination_signals", f"""
WITH {B.TEXTS} SELECT doc_id, {S.lexicon_hits(_LOW, P.UNCERTAINTY)} AS uncertainty_hits,
  {S.lexicon_hits(_LOW, P.OVERCONFIDENCE)} AS overconfidence_hits,
  {S.lexicon_hits(_LOW, P.FABRICATION)} AS fabrication_hits,
  {S.contradiction_hits(_LOW)} AS contradiction_hits, {S.words('text')} AS word_count FROM texts""")
def _(spark, sf):
    return hallucination.hallucination_signals(B.texts(spark, sf), "text").drop("text")


@check("hallucination_score", f"""
WITH {B.TEXTS}, s AS (SELECT doc_id, {S.hallucination('text')} AS score FROM texts)
SELECT doc_id, round(score, 6) AS score, score <= 0.6::DOUBLE AS passed FROM s""")
def _(spark, sf):
    out = hallucination.hallucination_score(B.texts(spark, sf), "text")
    return out.select("doc_id", B.six("score").alias("score"), "passed")


@check("hallucination_detail", f"""
WITH {B.TEXTS}, s AS (SELECT doc_id, {S.lexicon_list(_LOW, P.UNCERTAINTY)} AS uncertainty_phrases,
  {S.lexicon_list(_LOW, P.OVERCONFIDENCE)} AS overconfidence_phrases,
  {S.lexicon_list(_LOW, P.FABRICATION)} AS fabrication_indicators,
  {S.words('text')} AS word_count,
  {S.lexicon_list(_LOW, P.UNCERTAINTY + P.OVERCONFIDENCE + P.FABRICATION)} AS detected_items
  FROM texts) SELECT * FROM s""")
def _(spark, sf):
    out = hallucination.hallucination_detail(B.texts(spark, sf), "text")
    return out.select("doc_id", *[F.array_join(F.col("hallucination")[c], "|").alias(c) for c in (
        "uncertainty_phrases", "overconfidence_phrases", "fabrication_indicators")],
        "hallucination.word_count", F.array_join("detected_items", "|").alias("detected_items"))


@check("pii_counts", f"""
WITH {B.TEXTS} SELECT doc_id,
  {', '.join(f"{S.pii_count('text', c)} AS {c}_count" for c in P.PII_PATTERNS)},
  {S.pii_total('text')} AS total_matches FROM texts""")
def _(spark, sf):
    return pii.pii_counts(B.texts(spark, sf), "text").drop("text")


@check("pii_counts_subset", f"""
WITH {B.TEXTS} SELECT doc_id, {S.pii_count('text', 'ssn')} AS ssn_count,
  {S.pii_count('text', 'email')} AS email_count,
  {S.pii_total('text', ['ssn', 'email'])} AS total_matches FROM texts""")
def _(spark, sf):
    return pii.pii_counts(B.texts(spark, sf), "text", ["ssn", "email", "nonsense"]).drop("text")


@check("pii_score", f"""
WITH {B.TEXTS}, t AS (SELECT doc_id, {S.pii_total('text')} AS n FROM texts),
s AS (SELECT doc_id, {S.pii_score('n')} AS score FROM t)
SELECT doc_id, score, score <= 0.1::DOUBLE AS passed FROM s""")
def _(spark, sf):
    return pii.pii_score(B.texts(spark, sf), "text").select("doc_id", "score", "passed")


def _masked_sql(category: str) -> str:
    found = S.pii_matches("text", category)
    return f"list_transform({found}, lambda v: {S.mask('v', category)})"


_CATEGORIES_SQL = ("list_filter([" + ", ".join(
    f"CASE WHEN {S.pii_count('text', c)} > 0 THEN '{c}' END" for c in P.PII_PATTERNS)
    + "], lambda x: x IS NOT NULL)")
_ITEMS_SQL = ("list_filter([" + ", ".join(
    f"CASE WHEN {S.pii_count('text', c)} > 0 THEN '{c}: ' || {S.pii_count('text', c)} || ' found' "
    "END" for c in P.PII_PATTERNS) + "], lambda x: x IS NOT NULL)")


@check("pii_detail", f"""
WITH {B.TEXTS} SELECT doc_id, array_to_string({_CATEGORIES_SQL}, '|') AS categories_found,
  {S.pii_total('text')} AS total_matches, array_to_string({_ITEMS_SQL}, '|') AS detected_items,
  {', '.join(f"array_to_string({_masked_sql(c)}, '|') AS {c}" for c in P.PII_PATTERNS)}
FROM texts""")
def _(spark, sf):
    out = pii.pii_detail(B.texts(spark, sf), "text")
    masked = F.col("pii.matches_by_category")
    return out.select("doc_id", F.array_join("pii.categories_found", "|").alias("categories_found"),
                      "pii.total_matches",
                      F.array_join("detected_items", "|").alias("detected_items"),
                      *[F.coalesce(F.array_join(masked[c], "|"), F.lit("")).alias(c)
                        for c in P.PII_PATTERNS])


@check("mask_pii", f"""
WITH {B.TEXTS}, hits AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, unnest({S.pii_matches('text', c)}) AS value FROM texts"
    for c in P.PII_PATTERNS) + """)
SELECT doc_id, category, CASE category """ + " ".join(
    f"WHEN '{c}' THEN {S.mask('value', c)}" for c in P.PII_PATTERNS) + """ END AS masked,
  count(*) AS n FROM hits GROUP BY ALL""")
def _(spark, sf):
    """Every match of every category, masked."""
    detail = pii.pii_detail(B.texts(spark, sf), "text")
    return (detail.select("doc_id", F.explode("pii.matches_by_category")
                          .alias("category", "masked"))
            .select("doc_id", "category", F.explode("masked").alias("masked"))
            .groupBy("doc_id", "category", "masked").agg(F.count("*").alias("n")))


def _report_sql(source: str, text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS category, count(*) FILTER (n > 0) AS documents, sum(n)::BIGINT AS matches "
        f"FROM (SELECT {S.pii_count(text, c)} AS n FROM {source}) HAVING documents > 0"
        for c in P.PII_PATTERNS)


@check("pii_report", f"WITH {B.TEXTS} {_report_sql('texts', 'text')}")
def _(spark, sf):
    return pii.pii_report(B.texts(spark, sf), "text")


@check("pii_report_pages", _report_sql("pages", "html"))
def _(spark, sf):
    return pii.pii_report(B.table(spark, sf, "pages"), "html")


@check("injection_categories", f"""
WITH {B.TEXTS} SELECT doc_id,
  {', '.join(f"{S.injection_hit('text', c)} AS {c}" for c in P.INJECTION_PATTERNS)} FROM texts""")
def _(spark, sf):
    return injection.injection_categories(B.texts(spark, sf), "text").drop("text")


@check("injection_score", f"""
WITH {B.TEXTS}, s AS (SELECT doc_id, {S.injection_score('text')} AS score FROM texts)
SELECT doc_id, score, score <= 0.5::DOUBLE AS passed FROM s""")
def _(spark, sf):
    out = injection.injection_score(B.texts(spark, sf), "text")
    return out.select("doc_id", "score", "passed")


_INJ = {c: S.injection_matches("text", c) for c in P.INJECTION_PATTERNS}


@check("injection_detail", f"""
WITH {B.TEXTS}, m AS (SELECT doc_id, {S.injection_score('text')} AS score,
  {', '.join(f"{m} AS {c}" for c, m in _INJ.items())} FROM texts)
SELECT doc_id, {', '.join(
    f"array_to_string(list_transform({c}, lambda x: left(x, 50)), '|') AS {c}" for c in _INJ)},
  {' + '.join(f"len({c})" for c in _INJ)} AS total_patterns_matched,
  CASE WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.4::DOUBLE THEN 'medium' ELSE 'low' END
    AS risk_level,
  array_to_string(list_filter([{', '.join(
      f"CASE WHEN len({c}) > 0 THEN '{c}: ' || len({c}) || ' pattern(s)' END" for c in _INJ)}],
      lambda x: x IS NOT NULL), '|') AS detected_items
FROM m""")
def _(spark, sf):
    out = injection.injection_detail(B.texts(spark, sf), "text")
    info = F.col("prompt_injection")
    return out.select(
        "doc_id", *[F.coalesce(F.array_join(info["matches_by_category"][c], "|"), F.lit(""))
                    .alias(c) for c in P.INJECTION_PATTERNS],
        info["total_patterns_matched"].alias("total_patterns_matched"),
        info["risk_level"].alias("risk_level"),
        F.array_join("detected_items", "|").alias("detected_items"))


_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{r.rule_id}' AS rule_id, '{r.name}' AS name, "
    f"{r.severity}::DOUBLE AS severity, '{r.action}' AS action FROM texts "
    f"WHERE text <> '' AND {S.rule_fires('text', r)}" for r in S.active(B.RULES, "response"))


@check("rule_hits", f"WITH {B.TEXTS} {_HITS}")
def _(spark, sf):
    return rules.rule_hits(B.texts(spark, sf), "text", B.RULES, "response")


@check("rule_score", f"""
WITH {B.TEXTS}, s AS (SELECT doc_id, {S.rule_score('text', B.RULES, 'prompt')} AS score FROM texts)
SELECT doc_id, score, score <= 0.5::DOUBLE AS passed FROM s""")
def _(spark, sf):
    out = rules.rule_score(B.texts(spark, sf), "text", B.RULES, "prompt")
    return out.select("doc_id", "score", "passed")


@check("rule_score_both", f"""
WITH {B.TEXTS} SELECT doc_id, {S.rule_score('text', B.RULES, 'both')} AS score FROM texts""")
def _(spark, sf):
    """Target ``both`` takes only rules that apply to both."""
    out = rules.rule_score(B.texts(spark, sf), "text", B.RULES, "both")
    return out.select("doc_id", "score")


def _matched_sql(r) -> str:
    if r.rule_type == "regex":
        found = f"left(regexp_extract(text, '(?i)' || '{r.pattern}'), 50)"
    else:
        listed = ", ".join(f"'{k}'" for k in r.keywords)
        found = (f"array_to_string(list_filter([{listed}], "
                 "lambda k: contains(lower(text), k)), '+')")
    return (f"CASE WHEN text <> '' AND {S.rule_fires('text', r)} "
            f"THEN '{r.rule_id}=' || {found} END")


_ON = S.active(B.RULES, "response")


@check("rule_detail", f"""
WITH {B.TEXTS}, h AS (SELECT doc_id, list_filter([{', '.join(map(_matched_sql, _ON))}],
  lambda x: x IS NOT NULL) AS hits,
  {S.rule_ids('text', B.RULES, 'response', 'action')} AS actions,
  {S.rule_ids('text', B.RULES, 'response', 'name')} AS names FROM texts)
SELECT doc_id, len(hits) AS rules_triggered, array_to_string(hits, '|') AS triggered,
  list_contains(actions, 'block') AS blocked, array_to_string(names, '|') AS detected_items
FROM h""")
def _(spark, sf):
    out = rules.rule_detail(B.texts(spark, sf), "text", B.RULES, "response")
    shown = F.transform("custom_rules.triggered_rules", lambda r: F.concat(
        r["rule_id"], F.lit("="),
        F.coalesce(r["matched"], F.array_join(r["matched_keywords"], "+"))))
    return out.select("doc_id", "custom_rules.rules_triggered",
                      F.array_join(shown, "|").alias("triggered"), "custom_rules.blocked",
                      F.array_join("detected_items", "|").alias("detected_items"))


_TOX = (f"tox AS (SELECT id, tox_1, tox_2, CASE WHEN {S.blank('response')} THEN 0.0::DOUBLE "
        "ELSE greatest(tox_1, tox_2) END AS score FROM pairs)")


@check("toxicity_score", f"""
WITH {B.PAIRS}, {_TOX} SELECT id, round(score, 6) AS score, score <= 0.7::DOUBLE AS passed
FROM tox""")
def _(spark, sf):
    out = toxicity.toxicity_score(B.pairs(spark, sf), "toxicity_scores", "response")
    return out.select("id", B.six("score").alias("score"), "passed")


@check("toxicity_detail", f"""
WITH {B.PAIRS} SELECT id, CASE WHEN tox_1 >= tox_2 THEN 'toxicity' ELSE 'insult' END
  AS max_category, array_to_string(list_filter([CASE WHEN tox_1 > 0.7::DOUBLE THEN 'toxicity' END,
  CASE WHEN tox_2 > 0.7::DOUBLE THEN 'insult' END], lambda x: x IS NOT NULL), '|')
  AS detected_items FROM pairs""")
def _(spark, sf):
    out = toxicity.toxicity_detail(B.pairs(spark, sf), "toxicity_scores")
    return out.select("id", "toxicity.max_category",
                      F.array_join("detected_items", "|").alias("detected_items"))


# Naive Bayes spelt out: log priors and log shares of the buckets, both smoothed by 1.
@check("toxicity_bayes", f"""
WITH words AS (SELECT doc_id, unnest({S.word_buckets('text', 1 << 14)}) AS bucket FROM documents),
counted AS (SELECT doc_id, bucket, count(*) AS n FROM words GROUP BY ALL),
learnt AS (SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
totals AS (SELECT toxic, sum(n) AS n FROM counted JOIN learnt USING (doc_id) GROUP BY toxic),
shares AS (SELECT bucket, coalesce(sum(n) FILTER (toxic = 1), 0) AS bad,
  coalesce(sum(n) FILTER (toxic = 0), 0) AS good
  FROM counted LEFT JOIN learnt USING (doc_id) GROUP BY bucket),
weights AS (SELECT bucket, ln((bad + 1) / ((SELECT n FROM totals WHERE toxic = 1) + {1 << 14})::DOUBLE)
  - ln((good + 1) / ((SELECT n FROM totals WHERE toxic = 0) + {1 << 14})::DOUBLE) AS weight FROM shares),
prior AS (SELECT ln((count(*) FILTER (toxic = 1) + 1) / (count(*) FILTER (toxic = 0) + 1)::DOUBLE)
  AS odds FROM learnt),
sums AS (SELECT doc_id, sum(n * weight) AS weight FROM counted JOIN weights USING (bucket)
  GROUP BY doc_id)
SELECT d.doc_id, round(1 / (1 + exp(least(-(odds + coalesce(s.weight, 0)), 700))), 6) AS toxicity
FROM documents d LEFT JOIN sums s USING (doc_id) CROSS JOIN prior""")
def _(spark, sf):
    """Naive Bayes, trained on the labelled documents and applied to all of them."""
    return _by_model(spark, sf, toxicity.train_bayes)


@check("toxicity_model")
def _(spark, sf):
    """Logistic regression on TF-IDF, trained on the labelled documents and applied to all of them; a test
    compares it with a plain fit."""
    return _by_model(spark, sf, toxicity.train_stand_in)


def _by_model(spark, sf, train):
    documents = B.table(spark, sf, "documents").select("doc_id", "text")
    labelled = documents.join(B.table(spark, sf, "labels"), "doc_id")
    out = toxicity.toxicity_model(documents, "text", train(labelled, "text", "toxic"))
    return out.select("doc_id", B.six(F.col("toxicity_scores")["toxicity"]).alias("toxicity"))


@check("alignment_score", f"""
WITH {B.PAIRS}, {B.VECTORS}, s AS (SELECT id, CASE WHEN prompt = '' OR response = ''
  OR prompt_vector IS NULL OR response_vector IS NULL THEN 0.0::DOUBLE
  ELSE {S.cosine('prompt_vector', 'response_vector')} END AS score FROM vectored)
SELECT id, round(score, 6) AS score, score >= 0.5::DOUBLE AS passed FROM s""")
def _(spark, sf):
    out = alignment.alignment_score(B.with_vectors(spark, sf), "prompt", "response",
                                    "prompt_vector", "response_vector")
    return out.select("id", B.six("score").alias("score"), "passed")


@check("alignment_detail", f"""
WITH {B.PAIRS}, {B.VECTORS}, s AS (SELECT id, prompt, response, CASE WHEN prompt = ''
  OR response = '' OR prompt_vector IS NULL OR response_vector IS NULL THEN 0.0::DOUBLE
  ELSE {S.cosine('prompt_vector', 'response_vector')} END AS score FROM vectored)
SELECT id, CASE WHEN score >= 0.8::DOUBLE THEN 'high' WHEN score >= 0.5::DOUBLE THEN 'moderate'
  WHEN score >= 0.3::DOUBLE THEN 'low' ELSE 'very_low' END AS alignment_level,
  {S.words('prompt')} AS prompt_length, {S.words('response')} AS response_length FROM s""")
def _(spark, sf):
    out = alignment.alignment_score(B.with_vectors(spark, sf), "prompt", "response",
                                    "prompt_vector", "response_vector")
    out = alignment.alignment_detail(out, "score", "prompt", "response")
    return out.select("id", "alignment.*")


@check("alignment_embed", f"""
WITH {B.PAIRS},
a AS (SELECT id, bucket, count(*) AS n FROM (SELECT id, unnest({S.word_buckets('prompt', 256)})
  AS bucket FROM pairs) GROUP BY ALL),
b AS (SELECT id, bucket, count(*) AS n FROM (SELECT id, unnest({S.word_buckets('response', 256)})
  AS bucket FROM pairs) GROUP BY ALL),
lengths AS (SELECT id, (SELECT sum(n * n) FROM a WHERE a.id = pairs.id)::DOUBLE AS x,
  (SELECT sum(n * n) FROM b WHERE b.id = pairs.id)::DOUBLE AS y, prompt, response FROM pairs),
dots AS (SELECT id, sum(a.n * b.n)::DOUBLE AS dot FROM a JOIN b USING (id, bucket) GROUP BY id),
s AS (SELECT id, CASE WHEN prompt = '' OR response = '' THEN 0.0::DOUBLE
  ELSE coalesce(dot, 0) / (sqrt(x) * sqrt(y)) END AS score FROM lengths LEFT JOIN dots USING (id))
SELECT id, round(score, 6) AS score, score >= 0.5::DOUBLE AS passed FROM s""")
def _(spark, sf):
    """Alignment of every pair by the stand-in embeddings of its two texts."""
    found = alignment.alignment_embed(B.pairs(spark, sf), "prompt", "prompt_vector")
    found = alignment.alignment_embed(found, "response", "response_vector")
    out = alignment.alignment_score(found, "prompt", "response", "prompt_vector",
                                    "response_vector")
    return out.select("id", B.six("score").alias("score"), "passed")


@check("evaluator_registry", f"""
WITH {B.TEXTS} SELECT doc_id, (length(text) > 1000) AS long_text,
  round(CASE WHEN length(text) > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score,
  {S.injection_score('text')} AS prompt_injection FROM texts""")
def _(spark, sf):
    """A registered evaluator of one's own next to a built-in one."""
    known = registry.default_registry()
    known.register(registry.Evaluator(
        "length", "Texts that are too long",
        lambda text: F.when(F.length(text) > 1000, 1.0).otherwise(0.0)))
    return B.texts(spark, sf).select(
        "doc_id", (F.length("text") > 1000).alias("long_text"),
        known.get("length").score(F.col("text")).alias("score"),
        known.get("prompt_injection").score(F.col("text")).alias("prompt_injection"))


def _band_sql(score: str) -> str:
    return (f"CASE WHEN {score} < 0.3::DOUBLE THEN 'Low Risk' WHEN {score} < 0.6::DOUBLE "
            "THEN 'Medium Risk' ELSE 'High Risk' END")


@check("check_text", f"""
WITH {B.TEXTS}, t AS (SELECT doc_id, {S.pii_total('text')} AS n FROM texts),
s AS (SELECT doc_id, n, {S.pii_score('n')} AS score FROM t)
SELECT doc_id, score, {_band_sql('score')} AS risk_band, n AS total_matches FROM s""")
def _(spark, sf):
    out = registry.check_text(B.texts(spark, sf), "text", "pii", detailed=True)
    return out.select("doc_id", "score", "risk_band", "detail.total_matches")


@check("risk_band", f"""
WITH {B.TEXTS}, s AS (SELECT doc_id, {S.hallucination('text')} AS score FROM texts)
SELECT {_band_sql('score')} AS risk_band, count(*) AS n FROM s GROUP BY ALL""")
def _(spark, sf):
    out = registry.check_text(B.texts(spark, sf), "text", "hallucination")
    return out.groupBy("risk_band").agg(F.count("*").alias("n"))


@check("rule_match_stats", f"""
WITH {B.TEXTS}, h AS ({_HITS}), e AS (SELECT doc_id, max(ts) AS ts FROM
  (SELECT event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, ts FROM events)
  GROUP BY doc_id), j AS (SELECT h.rule_id, e.ts FROM h JOIN e USING (doc_id))
SELECT r.rule_id, count(j.rule_id) AS match_count,
  strftime(max(j.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_matched_at
FROM (SELECT unnest([{', '.join(f"'{r.rule_id}'" for r in B.RULES)}]) AS rule_id) r
LEFT JOIN j ON j.rule_id = r.rule_id GROUP BY r.rule_id""")
def _(spark, sf):
    """Matches of every rule in the documents, dated by the last event of the document."""
    size = B.table(spark, sf, "documents").agg(F.max("doc_id") + 1).scalar()
    seen = (B.table(spark, sf, "events")
            .select((F.col("event_id") % size).alias("doc_id"), "ts")
            .groupBy("doc_id").agg(F.max("ts").alias("ts")))
    dated = B.texts(spark, sf).join(seen, "doc_id")
    out = rules.rule_match_stats(dated, "text", "ts", B.RULES, "response")
    return out.select("rule_id", "match_count", B.stamp("last_matched_at"))


@check("preview_text", f"""
WITH {B.TEXTS} SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...'
  ELSE text END AS preview FROM texts""")
def _(spark, sf):
    return B.texts(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"))


# A table of rules made of the documents' own words: keywords, phrases, patterns, and some that need no literal.
_RULE_TABLE = r"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents),
picked AS (SELECT doc_id, w[doc_id * 7 % len(w) + 1] AS a, coalesce(w[doc_id * 7 % len(w) + 2], 'x') AS b,
  w[doc_id * 13 % len(w) + 1] AS c FROM words WHERE len(w) > 0),
rule_table AS (SELECT 'rule-' || doc_id AS rule_id, doc_id % 10 / 10.0::DOUBLE AS severity,
  CASE WHEN doc_id % 50 = 4 THEN '[0-9]{' || doc_id % 7 || ',}x?' WHEN doc_id % 5 = 0 THEN a || ' ' || b || ', ' || c
    WHEN doc_id % 5 = 1 THEN a || '\s+' || b WHEN doc_id % 5 = 2 THEN '(?:' || a || '|' || b || ')[.,]\s+' || c
    WHEN doc_id % 5 = 3 THEN upper(a) || ' ,' || b ELSE '(' || a || ')+ (' || b || '|' || c || ')' END AS pattern,
  CASE WHEN doc_id % 50 <> 4 AND doc_id % 5 IN (0, 3) THEN 'keyword' ELSE 'regex' END AS rule_type,
  CASE WHEN doc_id % 3 = 0 THEN 'prompt' WHEN doc_id % 3 = 1 THEN 'response' ELSE 'both' END AS apply_to,
  doc_id % 17 <> 0 AS enabled FROM picked)"""


def _rule_table(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)
    d, w = F.col("doc_id"), F.col("w")

    def word(factor, more=0):
        return F.get(w, (d * factor % F.size(w) + more).cast("int"))

    picked = (B.table(spark, sf, "documents").select("doc_id", words.alias("w")).filter("size(w) > 0")
              .select("doc_id", word(7).alias("a"), F.coalesce(word(7, 1), F.lit("x")).alias("b"),
                      word(13).alias("c")))
    plain = d % 50 != 4
    pattern = F.expr(r"""CASE WHEN doc_id % 50 = 4 THEN '[0-9]{' || doc_id % 7 || ',}x?'
      WHEN doc_id % 5 = 0 THEN a || ' ' || b || ', ' || c WHEN doc_id % 5 = 1 THEN a || '\\s+' || b
      WHEN doc_id % 5 = 2 THEN '(?:' || a || '|' || b || ')[.,]\\s+' || c
      WHEN doc_id % 5 = 3 THEN upper(a) || ' ,' || b ELSE '(' || a || ')+ (' || b || '|' || c || ')' END""")
    return picked.select(
        F.concat(F.lit("rule-"), d.cast("string")).alias("rule_id"), F.lit("made").alias("name"),
        pattern.alias("pattern"), F.when(plain & (d % 5).isin(0, 3), "keyword").otherwise("regex").alias("rule_type"),
        (d % 10 / F.lit(10.0)).alias("severity"), F.when(d % 3 == 0, "prompt").when(
            d % 3 == 1, "response").otherwise("both").alias("apply_to"), (d % 17 != 0).alias("enabled"))


_TABLE_HITS = f"""{B.TEXTS}, {_RULE_TABLE}, hits AS (SELECT doc_id, rule_id, severity FROM texts, rule_table
  WHERE enabled AND apply_to IN ('response', 'both') AND text <> '' AND CASE WHEN rule_type = 'regex'
    THEN regexp_matches(text, '(?i)' || pattern) ELSE len(list_filter(string_split(pattern, ','),
      lambda k: contains(lower(text), lower(trim(k))))) > 0 END)"""


@check("rule_hits_large", f"WITH {_TABLE_HITS} SELECT doc_id, rule_id, severity FROM hits")
def _(spark, sf):
    """A table with a rule per document, joined with all texts."""
    out = rules.rule_hits(B.texts(spark, sf), "text", _rule_table(spark, sf), "response")
    return out.select("doc_id", "rule_id", "severity")


@check("rule_score_large", f"""WITH {_TABLE_HITS} SELECT doc_id, coalesce(max(severity), 0) AS score,
  coalesce(max(severity), 0) <= 0.5::DOUBLE AS passed FROM texts LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def _(spark, sf):
    out = rules.rule_score(B.texts(spark, sf), "text", _rule_table(spark, sf), "response")
    return out.select("doc_id", "score", "passed")


@check("rule_match_stats_large", f"""WITH {_TABLE_HITS} SELECT r.rule_id, count(doc_id) AS match_count,
  max(doc_id) AS last_matched_at FROM rule_table r LEFT JOIN hits USING (rule_id) GROUP BY r.rule_id""")
def _(spark, sf):
    """The greatest document id stands for the last time."""
    out = rules.rule_match_stats(B.texts(spark, sf), "text", "doc_id", _rule_table(spark, sf), "response")
    return out.select("rule_id", "match_count", "last_matched_at")
