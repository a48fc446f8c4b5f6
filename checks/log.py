"""Checks of the log queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import base as B
from checks.registry import ORACLES, QUERIES, check
from wardspark.operators import log as L
from wardspark.operators import metrics as M
from wardspark.operators import rollup, search_index
from wardspark.session import scratch_path
from wardspark.sources import results

_START, _END = "2024-01-05 06:00:00", "2024-01-25 18:30:00"


def _near(column):
    """Six decimals of an average, moved off the ties that two-decimal inputs cause."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + 1.23e-8, 6)


def _six_sql(column: str) -> str:
    return f"round({column} + 1.23e-8, 6) AS {column.split('.')[-1]}"


@check("list_evaluations", f"""
{B.LOG} SELECT evaluation_id, {B.stamp_sql('"timestamp"')}, passed, {_six_sql('latency_ms')},
  (SELECT count(*) FROM log WHERE source = 'api' AND passed AND "timestamp" >= '{_START}'
   AND "timestamp" <= '{_END}') AS total
FROM log WHERE source = 'api' AND passed AND "timestamp" >= '{_START}' AND "timestamp" <= '{_END}'
ORDER BY log."timestamp" DESC, evaluation_id LIMIT 100 OFFSET 40""")
def _(spark, sf):
    rows, total = L.list_evaluations(B.log(spark, sf), offset=40, passed=True, source="api",
                                     start=_START, end=_END)
    return rows.select("evaluation_id", B.stamp("timestamp"), "passed",
                       _near("latency_ms").alias("latency_ms"), total.scalar().alias("total"))


@check("list_evaluations_by_latency", f"""
{B.LOG} SELECT evaluation_id, {_six_sql('latency_ms')} FROM log
WHERE user_id = 'u8' ORDER BY log.latency_ms ASC NULLS FIRST, evaluation_id LIMIT 25""")
def _(spark, sf):
    rows, _ = L.list_evaluations(B.log(spark, sf), limit=25, user_id="u8", source="",
                                 order_by="latency_ms", descending=False)
    return rows.select("evaluation_id", _near("latency_ms").alias("latency_ms"))


@check("page", f"""
{B.LOG} SELECT evaluation_id, row_number() OVER (ORDER BY "timestamp" DESC, evaluation_id) AS n
FROM log QUALIFY n > 9995 AND n <= 10100""")
def _(spark, sf):
    """A page so far from the front that it is found by rank."""
    slim = B.log(spark, sf).select("timestamp", "evaluation_id")
    order = L.NEWEST_FIRST
    rows = L.page(slim, order, 105, 9995)
    return L.running_total(rows, [], order, "n").select("evaluation_id", (F.col("n") + 9995)
                                                        .alias("n"))


_SOME_ID = f"SELECT max(evaluation_id) FROM log WHERE source = 'cli'"


@check("get_evaluation", f"""
{B.LOG} SELECT evaluation_id, id, event_id, passed FROM log WHERE evaluation_id = ({_SOME_ID})""")
def _(spark, sf):
    log = B.log(spark, sf)
    wanted = log.filter("source = 'cli'").agg(F.max("evaluation_id")).scalar()
    return L.get_evaluation(log, wanted).select("evaluation_id", "id", "event_id", "passed")


@check("find_evaluation", f"""
{B.LOG} SELECT evaluation_id, id, passed, strftime("timestamp", '%Y-%m-%d') AS dt FROM log
WHERE evaluation_id = ({_SOME_ID})""")
def _(spark, sf):
    """The same row in a log on disk: one day of it is read."""
    path = scratch_path(spark, "evaluations")
    log = B.log(spark, sf)
    results.append_evaluations(log, path)
    wanted = log.filter("source = 'cli'").agg(F.max("evaluation_id")).head()[0]
    found = results.find_evaluation(spark, path, wanted)
    known = log.filter(F.col("evaluation_id") == wanted).select("evaluation_id", "id").distinct()
    return found.join(known, "evaluation_id").select(
        "evaluation_id", "id", "passed", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@check("search_evaluations", f"""
{B.LOG} SELECT evaluation_id, {B.stamp_sql('"timestamp"')} FROM log
WHERE prompt ILIKE '%sys_em PROMPT%' OR response ILIKE '%sys_em PROMPT%'
ORDER BY log."timestamp" DESC, evaluation_id LIMIT 50""")
def _(spark, sf):
    rows = L.search_evaluations(B.log(spark, sf), "sys_em PROMPT")
    return rows.select("evaluation_id", B.stamp("timestamp"))


@check("search_indexed", ORACLES["search_evaluations"])
def _(spark, sf):
    """The same rows by an index of trigrams, appended in two runs."""
    log, path = B.log(spark, sf), scratch_path(spark, "grams")
    for n in range(2):
        search_index.append_index(log.filter(F.col("event_id") % 2 == n), path)
    rows = search_index.search_indexed(log, path, "sys_em PROMPT")
    return rows.select("evaluation_id", B.stamp("timestamp"))


def _rate(part: str, whole: str) -> str:
    return f"round({part} * 100.0::DOUBLE / {whole} + 1.23e-8, 6) AS pass_rate"


_VERDICTS = ("count(*) AS total, count(*) FILTER (passed) AS passed, "
             "count(*) FILTER (NOT passed) AS failed")


@check("statistics", f"""
{B.LOG} SELECT {_VERDICTS}, round(avg(latency_ms) + 1.23e-8, 6) AS avg_latency_ms,
  {_rate('count(*) FILTER (passed)', 'count(*)')} FROM log
WHERE "timestamp" >= '{_START}' AND "timestamp" <= '{_END}'""")
def _(spark, sf):
    out = M.statistics(B.log(spark, sf), _START, _END)
    return out.select("total", "passed", "failed", _near("avg_latency_ms").alias("avg_latency_ms"),
                      _near("pass_rate").alias("pass_rate"))


@check("file_summary", f"""
{B.LOG} SELECT {_VERDICTS}, round(avg(tox) + 1.23e-8, 6) AS avg_toxicity, round(avg(ali) + 1.23e-8, 6) AS avg_alignment,
  {_rate('count(*) FILTER (passed)', 'count(*)')} FROM log""")
def _(spark, sf):
    out = M.file_summary(B.log(spark, sf))
    return out.select("total", "passed", "failed", *[_near(c).alias(c) for c in (
        "avg_toxicity", "avg_alignment", "pass_rate")])


def _type_sql(size: int) -> str:
    return (f"CASE WHEN contains(flag, ':') THEN split_part(flag, ':', 1) "
            f"ELSE left(flag, {size}) END")


def _hourly_sql(period: str = "hour") -> str:
    return f"""{B.LOG}, base AS (SELECT date_trunc('{period}', "timestamp") AS period_start,
  count(*) AS total_evaluations, count(*) FILTER (passed) AS passed_count,
  count(*) FILTER (NOT passed) AS failed_count,
  coalesce(avg(latency_ms) FILTER (latency_ms <> 0), 0) AS avg_latency_ms,
  avg(coalesce(tox, 0)) FILTER (has_scores) AS avg_toxicity,
  avg(coalesce(ali, 0)) FILTER (has_scores) AS avg_alignment FROM log GROUP BY ALL),
exploded AS (SELECT date_trunc('{period}', "timestamp") AS period_start, unnest(flags) AS flag
  FROM log),
typed AS (SELECT period_start, {_type_sql(30)} AS flag_type, count(*) AS n FROM exploded
  GROUP BY ALL),
flagged AS (SELECT period_start, string_agg(flag_type || '=' || n, '; ' ORDER BY flag_type)
  AS flag_counts FROM typed GROUP BY ALL),
summaries AS (SELECT strftime(base.period_start, '%Y-%m-%d %H:%M:%S.%f') AS period_start,
  total_evaluations, passed_count, failed_count, {_six_sql('avg_latency_ms')},
  {_six_sql('avg_toxicity')}, {_six_sql('avg_alignment')},
  coalesce(flag_counts, '') AS flag_counts
  FROM base LEFT JOIN flagged ON base.period_start = flagged.period_start)"""


def _summary_rows(out):
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("flag_counts")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return out.select(
        B.stamp("period_start"), "total_evaluations", "passed_count", "failed_count",
        *[_near(c).alias(c) for c in ("avg_latency_ms", "avg_toxicity", "avg_alignment")],
        counts.alias("flag_counts"))


@check("aggregate_hourly", f"{_hourly_sql()} SELECT * FROM summaries")
def _(spark, sf):
    return _summary_rows(M.aggregate_hourly(B.log(spark, sf)))


@check("upsert_summary", f"{_hourly_sql()} SELECT * FROM summaries")
def _(spark, sf):
    """Summaries of an incomplete log, replaced by those of the whole one."""
    path = scratch_path(spark, "summaries")
    log = B.log(spark, sf)
    results.replace_periods(M.aggregate_hourly(log.filter("passed")), path)
    results.replace_periods(M.aggregate_hourly(log), path)
    return _summary_rows(spark.read.parquet(path))


@check("upsert_one_hour", f"{_hourly_sql()} SELECT * FROM summaries")
def _(spark, sf):
    """Every fifth hour replaced alone; the other hours of its day stay."""
    path = scratch_path(spark, "summaries")
    whole = M.aggregate_hourly(B.log(spark, sf))
    fifth = F.hour("period_start") % 5 == 0
    results.replace_periods(whole.withColumn("passed_count", F.when(fifth, 0).otherwise(
        F.col("passed_count")).cast("long")), path)
    results.replace_periods(whole.filter(fifth), path)
    return _summary_rows(spark.read.parquet(path))


_NOW = datetime(2024, 1, 30, 12, 30)


@check("dashboard_series", f"""
{_hourly_sql()} SELECT period_start, total_evaluations, passed_count, failed_count,
  avg_latency_ms AS avg_latency FROM summaries WHERE period_start >= '2024-01-28 12:30:00'
ORDER BY period_start""")
def _(spark, sf):
    out = M.dashboard_series(M.aggregate_hourly(B.log(spark, sf)), _NOW, 48)
    return out.select(B.stamp("period_start"), "total_evaluations", "passed_count", "failed_count",
                      _near("avg_latency").alias("avg_latency"))


_SUMMARY = """summary AS (SELECT count(*) AS total_evaluations,
  count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count,
  avg(coalesce(latency_ms, 0)) AS average_latency_ms,
  count(*) / ((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6) * 60
    AS evaluations_per_minute FROM newest)"""


@check("metrics_summary", f"""
{B.LOG}, newest AS (FROM log), {_SUMMARY} SELECT total_evaluations, passed_count, failed_count,
  {_six_sql('average_latency_ms')}, {_six_sql('evaluations_per_minute')} FROM summary""")
def _(spark, sf):
    out = M.metrics_summary(B.log(spark, sf))
    return out.select("total_evaluations", "passed_count", "failed_count",
                      *[_near(c).alias(c) for c in ("average_latency_ms",
                                                    "evaluations_per_minute")])


@check("scores_summary", f"""
{B.LOG_LONG} SELECT metric, round(min(value) + 1.23e-8, 6) AS min, round(max(value) + 1.23e-8, 6) AS max,
  round(avg(value) + 1.23e-8, 6) AS avg FROM long WHERE value IS NOT NULL GROUP BY metric""")
def _(spark, sf):
    out = M.scores_summary(B.log(spark, sf))
    return out.select("metric", *[_near(c).alias(c) for c in ("min", "max", "avg")])


@check("top_flags", f"""
{B.LOG}, f AS (SELECT unnest(flags) AS flag FROM log)
SELECT {_type_sql(50)} AS flag, count(*) AS count FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    return M.top_flags(B.log(spark, sf))


@check("prometheus_rows", f"""
{B.LOG}, newest AS (FROM log), {_SUMMARY}, averages AS (""" + " UNION ALL ".join(
    f"SELECT '{B.KEYS[n]}' AS metric, avg({n}) AS value FROM newest" for n in B.SCORES) + """)
SELECT 'guardrail_evaluations_total' AS name, 'counter' AS type,
  total_evaluations::VARCHAR AS value FROM summary
UNION ALL SELECT 'guardrail_evaluations_passed', 'counter', passed_count::VARCHAR FROM summary
UNION ALL SELECT 'guardrail_evaluations_failed', 'counter', failed_count::VARCHAR FROM summary
UNION ALL SELECT 'guardrail_latency_avg_ms', 'gauge', printf('%.2f', average_latency_ms)
  FROM summary
UNION ALL SELECT 'guardrail_evaluations_per_minute', 'gauge',
  printf('%.2f', evaluations_per_minute) FROM summary
UNION ALL SELECT 'guardrail_score_' || metric || '_avg', 'gauge', printf('%.4f', value)
  FROM averages""")
def _(spark, sf):
    return M.prometheus_rows(B.log(spark, sf))


# the names of an earlier round, when the newest rows were registered too
for _name in ("metrics_summary", "prometheus_rows"):
    check(f"{_name}_whole", ORACLES[_name])(QUERIES[_name])


@check("history_metrics", f"""
{B.LOG} SELECT count(*) AS total, round(avg(coalesce(tox, 0)) + 1.23e-8, 6) AS avg_toxicity,
  round(avg(coalesce(ali, 0)) + 1.23e-8, 6) AS avg_alignment, sum(len(flags))::BIGINT AS total_flags,
  {_rate('count(*) FILTER (passed)', 'count(*)')} FROM log""")
def _(spark, sf):
    out = M.history_metrics(B.log(spark, sf))
    return out.select("total", "total_flags", *[_near(c).alias(c) for c in (
        "avg_toxicity", "avg_alignment", "pass_rate")])


@check("pass_fail_counts", f"""
{B.LOG} SELECT passed, count(*) AS count FROM log GROUP BY passed""")
def _(spark, sf):
    return M.pass_fail_counts(B.log(spark, sf))


@check("score_histogram", f"""
{B.LOG_LONG} SELECT metric, CASE WHEN value < 0 THEN 0
  ELSE least(floor(value * 20.0::DOUBLE)::BIGINT + 1, 20) END AS bucket, count(*) AS count
FROM long WHERE value IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return M.score_histogram(B.log(spark, sf))


@check("score_quartiles", f"""
{B.LOG_LONG} SELECT metric, round(min(value) + 1.23e-8, 6) AS min,
  round(quantile_cont(value, 0.25) + 1.23e-8, 6) AS q1, round(quantile_cont(value, 0.5) + 1.23e-8, 6) AS median,
  round(quantile_cont(value, 0.75) + 1.23e-8, 6) AS q3, round(max(value) + 1.23e-8, 6) AS max
FROM long WHERE value IS NOT NULL GROUP BY metric HAVING sum(value) > 0""")
def _(spark, sf):
    out = M.score_quartiles(B.log(spark, sf))
    return out.select("metric", *[_near(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@check("flag_value_counts", f"""
{B.LOG}, f AS (SELECT unnest(flags) AS flag FROM log)
SELECT flag, count(*) AS count FROM f GROUP BY flag""")
def _(spark, sf):
    return M.flag_value_counts(B.log(spark, sf))


def _period_sql(period: str) -> str:
    return f"""{B.LOG} SELECT strftime(date_trunc('{period}', "timestamp"), '%Y-%m-%d') AS day,
  round(avg(hal) + 1.23e-8, 6) AS avg_hallucination, round(avg(pii) + 1.23e-8, 6) AS avg_pii_risk,
  count(*) AS n FROM log GROUP BY ALL"""


@check("period_metrics", _period_sql("day"))
def _(spark, sf):
    log = B.log(spark, sf)
    day = F.date_trunc("day", "timestamp").alias("period_start")
    counts = log.groupBy(day).agg(F.count("*").alias("n"))
    out = M.period_metrics(log, "day").join(counts, "period_start")
    return out.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), "n",
                      *[_near(c).alias(c) for c in ("avg_hallucination", "avg_pii_risk")])


@check("period_metrics_latency", f"""{B.LOG}
SELECT strftime(date_trunc('week', "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS period_start,
  quantile_disc(latency_ms, 0.95) AS p95_latency_ms, quantile_disc(latency_ms, 0.99)
  AS p99_latency_ms FROM log GROUP BY date_trunc('week', "timestamp")""")
def _(spark, sf):
    """Exact latency percentiles per week."""
    out = M.period_metrics(B.log(spark, sf), "week")
    return out.select(B.stamp("period_start"), "p95_latency_ms", "p99_latency_ms")


@check("aggregate_weekly", f"{_hourly_sql('week')} SELECT * FROM summaries")
def _(spark, sf):
    return _summary_rows(M.aggregate_periods(B.log(spark, sf), "week"))


def _rolled(spark, sf):
    """Parts of the log appended in three runs, each with rows of every day."""
    path = scratch_path(spark, "parts")
    for n in range(3):
        rollup.append_parts(B.log(spark, sf).filter(F.col("event_id") % 3 == n), path)
    return rollup.read_parts(spark, path)


@check("rollup_daily", f"{_hourly_sql('day')} SELECT * FROM summaries")
def _(spark, sf):
    return _summary_rows(rollup.summaries(_rolled(spark, sf), "day"))


@check("rollup_latency", ORACLES["period_metrics_latency"])
def _(spark, sf):
    """Exact latency percentiles per week from counted values."""
    out = rollup.period_metrics(_rolled(spark, sf), "week")
    return out.select(B.stamp("period_start"), "p95_latency_ms", "p99_latency_ms")


@check("batch_score_table", f"""
{B.LOG} SELECT evaluation_id, passed, {', '.join(
    f'round(coalesce({n}, 0.0::DOUBLE) + 1.23e-8, 6) AS {B.KEYS[n]}' for n in B.SCORES[:5])},
  len(flags) AS flags_count, (SELECT round(avg(len(flags)) + 1.23e-8, 6) FROM log) AS avg_flags FROM log""")
def _(spark, sf):
    keys = [B.KEYS[n] for n in B.SCORES[:5]]
    out = M.batch_score_table(B.log(spark, sf), "evaluation_id", keys)
    mean = out.agg(_near(F.avg("flags_count"))).scalar()
    return out.select("evaluation_id", "passed", *[_near(k).alias(k) for k in keys],
                      "flags_count", mean.alias("avg_flags"))


@check("timeline", f"""
{B.LOG} SELECT evaluation_id, source, CASE WHEN passed THEN 'Passed' ELSE 'Failed' END AS result,
  row_number() OVER (PARTITION BY source ORDER BY "timestamp", evaluation_id) AS ordinal
FROM log""")
def _(spark, sf):
    out = L.timeline(B.log(spark, sf), "source")
    return out.select("evaluation_id", "source", "result", "ordinal")


@check("timeline_by_user", f"""
{B.LOG} SELECT evaluation_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", evaluation_id) AS ordinal
FROM log""")
def _(spark, sf):
    """Evaluations without a user are a group of their own."""
    return L.timeline(B.log(spark, sf), "user_id").select("evaluation_id", "user_id", "ordinal")


@check("trend", f"""
{B.LOG_LONG} SELECT evaluation_id, {B.stamp_sql('"timestamp"')}, metric, round(value + 1.23e-8, 6) AS value
FROM long""")
def _(spark, sf):
    out = L.trend(B.log(spark, sf))
    return out.select("evaluation_id", B.stamp("timestamp"), "metric", _near("value").alias("value"))


@check("history_view", f"""
{B.LOG} SELECT evaluation_id, {B.stamp_sql('"timestamp"')},
  CASE WHEN length(prompt) > 100 THEN left(prompt, 100) || '...' ELSE prompt END AS prompt,
  CASE WHEN length(response) > 100 THEN left(response, 100) || '...' ELSE response END AS response,
  passed, array_to_string(flags, ' | ') AS flags
FROM log ORDER BY log."timestamp" DESC, evaluation_id LIMIT 200""")
def _(spark, sf):
    out = L.history_view(B.log(spark, sf), 200)
    return out.select("evaluation_id", B.stamp("timestamp"), "prompt", "response", "passed",
                      F.array_join("flags", " | ").alias("flags"))


@check("retention", f"""
{B.LOG} SELECT 'kept' AS part, strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS n FROM log
WHERE "timestamp" >= '2024-01-20 12:30:00' GROUP BY ALL
UNION ALL SELECT 'expired', NULL, count(*) FROM log WHERE "timestamp" < '2024-01-20 12:30:00'""")
def _(spark, sf):
    """The log on disk after its old days are gone, and how many rows went."""
    path = scratch_path(spark, "evaluations")
    results.append_evaluations(B.log(spark, sf), path)
    gone = results.expire_days(spark, path, _NOW, 10)
    kept = (results.read_log(spark, path)
            .groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
            .agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "day", "n"))
    lost = spark.range(1).select(F.lit("expired").alias("part"),
                                 F.lit(None).cast("string").alias("day"), F.lit(gone).alias("n"))
    return kept.unionByName(lost)


@check("retention_split", f"""
{B.LOG} SELECT "timestamp" >= '2024-01-20 12:30:00' AS kept, count(*) AS n FROM log GROUP BY ALL""")
def _(spark, sf):
    kept, expired = L.retention(B.log(spark, sf), _NOW, 10)
    return (kept.select(F.lit(True).alias("kept")).unionByName(
        expired.select(F.lit(False).alias("kept"))).groupBy("kept").agg(F.count("*").alias("n")))
