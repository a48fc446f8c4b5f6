"""Tables the checks share, derived by Spark and by SQL from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as S
from checks.planting import (PROMPT_PHRASES, RESPONSE_PHRASES, planted, planted_sql, quoted)
from wardspark.config import EvalConfig
from wardspark.operators.rules import Rule
from wardspark.plans.evaluate import evaluate
from wardspark.session import scratch_path
from wardspark.sources.pairs import pairs_from_conversations

RULES = [
    Rule("price", "Price mention", r"\$\d+(\.\d{2})?", "regex", 0.8, "flag", "both"),
    Rule("secret", "Secrets", "secret, hidden", "keyword", 0.6, "block", "prompt"),
    Rule("spam", "Spam", "spam", "keyword"),
    Rule("rivals", "Rivals", "competitor,rival", "keyword", 0.9, "score", "response"),
    Rule("ferry", "Ferry word", r"\bferry\b", "regex", 0.55, "flag", "response"),
    Rule("broken", "Invalid", "(", "regex", 1.0),
    Rule("off", "Disabled", "the", "keyword", 1.0, enabled=False),
    Rule("bar", "Literal bar", "competitor | rival", "keyword", 0.7, "flag", "prompt"),
]

FULL = EvalConfig.everything()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores by their first column: the test tables are single files, and scoring is bound by CPU.

    Dealt out in turn, they would be sorted first, texts and all, by the few tasks that read such a file."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(df.columns[0]))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text``: documents with planted phrases of both kinds, dealt out once per session."""
    return stored(spark, sf, "texts", _texts)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    documents = dealt(table(spark, sf, "documents").select("doc_id", "text"))
    return documents.select("doc_id", planted(
        F.col("text"), F.col("doc_id"), PROMPT_PHRASES + RESPONSE_PHRASES).alias("text"))


TEXTS = ("texts AS (SELECT doc_id, "
         + planted_sql("text", "doc_id", PROMPT_PHRASES + RESPONSE_PHRASES)
         + " AS text FROM documents)")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``id, conv_id, turn, prompt, response, toxicity_scores``: planted pairs, dealt out once per session."""
    return stored(spark, sf, "pairs", _pairs)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = dealt(pairs_from_conversations(table(spark, sf, "conversations")))
    key = F.col("conv_id") * 7 + F.col("turn")
    first = (F.col("conv_id") * 31 + F.col("turn") * 17) % 100
    second = (F.col("conv_id") * 13 + F.col("turn") * 7) % 90
    return found.select(
        "id", "conv_id", "turn", planted(F.col("prompt"), key, PROMPT_PHRASES).alias("prompt"),
        planted(F.col("response"), key + 1, RESPONSE_PHRASES).alias("response"),
        F.create_map(F.lit("toxicity"), first / 100.0, F.lit("insult"), second / 100.0)
        .alias("toxicity_scores"))


PAIRS = (
    "raw_pairs AS (SELECT conv_id, turn, text AS prompt, "
    "lead(text) OVER w AS response, role, lead(role) OVER w AS next_role "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "pairs AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, "
    + planted_sql("prompt", "conv_id * 7 + turn", PROMPT_PHRASES) + " AS prompt, "
    + planted_sql("response", "conv_id * 7 + turn + 1", RESPONSE_PHRASES) + " AS response, "
    "((conv_id * 31 + turn * 17) % 100) / 100.0::DOUBLE AS tox_1, "
    "((conv_id * 13 + turn * 7) % 90) / 100.0::DOUBLE AS tox_2 "
    "FROM raw_pairs WHERE role = 'user' AND next_role = 'assistant')")


def with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with an embedding for each side, taken from the table of embeddings."""
    vectors = table(spark, sf, "embeddings")
    size = vectors.agg(F.count("*")).scalar()
    at = F.col("conv_id") * 2 + F.col("turn")
    shift = F.when(F.col("turn") % 4 == 0, 0).otherwise(1)
    keyed = pairs(spark, sf).withColumn("_p", at % size).withColumn("_r", (at + shift) % size)

    def side(key, name):
        return vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))

    return (keyed.join(side("_p", "prompt_vector"), "_p", "left")
            .join(side("_r", "response_vector"), "_r", "left").drop("_p", "_r"))


VECTORS = (
    "vectored AS (SELECT p.*, a.embedding AS prompt_vector, b.embedding AS response_vector "
    "FROM pairs p "
    "LEFT JOIN embeddings a ON a.vec_id = (conv_id * 2 + turn) % (SELECT count(*) FROM embeddings) "
    "LEFT JOIN embeddings b ON b.vec_id = (conv_id * 2 + turn + CASE WHEN turn % 4 = 0 THEN 0 "
    "ELSE 1 END) % (SELECT count(*) FROM embeddings))")


def evaluated(spark: SparkSession, sf: str, config: EvalConfig = FULL) -> DataFrame:
    return evaluate(with_vectors(spark, sf), config, RULES)


SCORES = ["tox", "ali", "hal", "pii", "inj", "rul"]
KEYS = {"tox": "toxicity", "ali": "alignment", "hal": "hallucination_risk", "pii": "pii_risk",
        "inj": "prompt_injection_risk", "rul": "custom_rules"}
_NAMES = {"tox": "toxicity", "ali": "alignment", "hal": "hallucination", "pii": "pii",
          "inj": "prompt_injection", "rul": "custom_rules"}

RAW_SCORES = (
    "raw_scores AS (SELECT *, "
    f"CASE WHEN {S.blank('response')} THEN 0.0::DOUBLE ELSE greatest(tox_1, tox_2) END AS tox, "
    "CASE WHEN prompt = '' OR response = '' OR prompt_vector IS NULL OR response_vector IS NULL "
    f"THEN 0.0::DOUBLE ELSE {S.cosine('prompt_vector', 'response_vector')} END AS ali, "
    f"{S.hallucination('response')} AS hal, "
    f"{S.pii_total('prompt')} AS pii_p_n, {S.pii_total('response')} AS pii_r_n, "
    f"{S.injection_score('prompt')} AS inj, "
    f"greatest({S.rule_score('prompt', RULES, 'prompt')}, "
    f"{S.rule_score('response', RULES, 'response')}) AS rul "
    "FROM vectored), "
    f"sided AS (SELECT *, {S.pii_score('pii_p_n')} AS pii_p, {S.pii_score('pii_r_n')} AS pii_r "
    "FROM raw_scores), "
    "scored AS (SELECT *, greatest(pii_p, pii_r) AS pii, "
    "sha256(prompt || '|||' || response) AS pair_key FROM sided)")


def flag_sql(name: str, config: EvalConfig = FULL, value: str | None = None) -> str:
    """Flag text of one score, or null."""
    value = value or name
    limit = f"{config.threshold(_NAMES[name])}::DOUBLE"
    label = {"tox": "'High toxicity detected'", "ali": "'Low prompt-response alignment'",
             "hal": "'Potential hallucination detected'",
             "pii": "'PII detected in ' || CASE WHEN pii_p > pii_r THEN 'prompt' "
                    "ELSE 'response' END",
             "inj": "'Potential prompt injection'", "rul": "'Custom rule violation'"}[name]
    sign = "<" if name == "ali" else ">"
    return f"CASE WHEN {value} {sign} {limit} THEN {label} || ': ' || printf('%.2f', {value}) END"


def flags_sql(config: EvalConfig = FULL) -> str:
    on = [n for n in SCORES if getattr(config, _NAMES[n])]
    if not on:
        return "[]::VARCHAR[]"
    return (f"list_filter([{', '.join(flag_sql(n, config) for n in on)}], "
            "lambda x: x IS NOT NULL)")


def evaluated_sql(config: EvalConfig = FULL) -> str:
    return (f"WITH {PAIRS}, {VECTORS}, {RAW_SCORES}, "
            f"evaluated AS (SELECT *, {flags_sql(config)} AS flags, "
            f"'eval_' || substr(sha256(id || '|' || pair_key), 1, 24) AS evaluation_id "
            "FROM scored)")


EVALUATED = evaluated_sql()

UNCODED_FLAG = "Manual review requested by the on-call moderation team today"


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf: str, label: str, make) -> DataFrame:
    """``make(spark, sf)`` written once per session: log queries read a log, as in use, and don't score it."""
    return spark.read.parquet(stored_path(spark, sf, label, make))


def stored_path(spark: SparkSession, sf: str, label: str, make) -> str:
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _STORED:
        path = scratch_path(spark, label)
        make(spark, sf).write.parquet(path)
        _STORED[key] = path
    return _STORED[key]


def log(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation log: every event replays the pairs of one conversation."""
    return stored(spark, sf, "log", _log)


def log_stream(spark: SparkSession, sf: str, batches: int) -> DataFrame:
    """The log's own files as a stream of about so many micro-batches; no copy is made."""
    rows = log(spark, sf)
    files = -(-len(rows.inputFiles()) // batches)
    return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(files, 1))
            .parquet(stored_path(spark, sf, "log", _log)))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    size = turns.agg(F.max("conv_id") + 1).scalar()
    events = table(spark, sf, "events").withColumn("conv_id", F.col("event_id") % size)
    joined = events.join(evaluated(spark, sf), "conv_id")
    e = F.col("event_id")
    extra = F.when(e % 19 == 0, F.array(F.lit(UNCODED_FLAG))).otherwise(
        F.array().cast("array<string>"))
    ident = F.sha2(F.concat(e.cast("string"), F.lit("-"), F.col("id"), F.lit("|"), "pair_key"), 256)
    no_scores = F.create_map().cast("map<string,double>")
    return joined.select(
        F.concat(F.lit("eval_"), F.substring(ident, 1, 24)).alias("evaluation_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), "prompt", "response",
        (F.col("passed") & (e % 19 != 0)).alias("passed"),
        F.when(e % 29 == 0, no_scores).otherwise(F.col("scores")).alias("scores"),
        F.concat("flags", extra).alias("flags"), "metadata",
        F.when(e % 13 == 0, F.lit(None)).when(e % 11 == 0, 0.0).otherwise(F.col("value"))
        .alias("latency_ms"),
        F.when(F.col("event_type").isin("click", "view"), "api")
        .when(F.col("event_type") == "purchase", "cli").otherwise("dashboard").alias("source"),
        F.when(F.col("user_id") != 7, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .alias("user_id"),
        F.lit(None).cast("string").alias("session_id"), "event_id", "id")


LOG = EVALUATED + (
    ", log AS (SELECT 'eval_' || substr(sha256(event_id || '-' || id || '|' || pair_key), 1, 24) "
    "AS evaluation_id, ts AS \"timestamp\", prompt, response, "
    "(len(flags) = 0 AND event_id % 19 <> 0) AS passed, "
    + ", ".join(f"CASE WHEN event_id % 29 = 0 THEN NULL ELSE {n} END AS {n}" for n in SCORES)
    + ", event_id % 29 <> 0 AS has_scores, "
    f"list_concat(flags, CASE WHEN event_id % 19 = 0 THEN [{quoted(UNCODED_FLAG)}] "
    "ELSE []::VARCHAR[] END) AS flags, "
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0.0::DOUBLE "
    "ELSE value END AS latency_ms, "
    "CASE WHEN event_type IN ('click', 'view') THEN 'api' WHEN event_type = 'purchase' "
    "THEN 'cli' ELSE 'dashboard' END AS source, "
    "CASE WHEN user_id <> 7 THEN 'u' || user_id END AS user_id, event_id, id, pii_p, pii_r "
    "FROM events JOIN evaluated ON evaluated.conv_id = "
    "event_id % (SELECT max(conv_id) + 1 FROM conversations))")

_LONG = " UNION ALL ".join(
    f"SELECT evaluation_id, \"timestamp\", '{KEYS[n]}' AS metric, {n} AS value FROM log "
    f"WHERE has_scores" for n in SCORES)
LOG_LONG = f"{LOG}, long AS ({_LONG})"


def six(column) -> "F.Column":
    return F.round(column, 6)


def flat_scores(df: DataFrame):
    return [six(F.col("scores")[KEYS[n]]).alias(n) for n in SCORES]


FLAT = ", ".join(f"round({n}, 6) AS {n}" for n in SCORES)


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"
