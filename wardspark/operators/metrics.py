"""Aggregations over the evaluation log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators.log import filtered, page
from wardspark.operators.ranking import nearest_ranks, quantiles
from wardspark.session import moment


def flag_type(flag: Column, size: int) -> Column:
    """Text before the first colon, else the first ``size`` characters."""
    return F.when(F.contains(flag, F.lit(":")), F.substring_index(flag, ":", 1)
                  ).otherwise(F.substring(flag, 1, size))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _verdicts() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("failed")]


def statistics(log: DataFrame, start=None, end=None) -> DataFrame:
    out = filtered(log, start=start, end=end).agg(
        *_verdicts(), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
    return out.withColumn("pass_rate", _percent(F.col("passed"), F.col("total")))


def file_summary(results: DataFrame) -> DataFrame:
    """Totals and averages over the scores that are present."""
    out = results.agg(*_verdicts(), F.avg(F.col("scores")["toxicity"]).alias("avg_toxicity"),
                      F.avg(F.col("scores")["alignment"]).alias("avg_alignment"))
    return out.withColumn("pass_rate", _percent(F.col("passed"), F.col("total")))


_SUMS = ["n", "passed", "latency", "n_latency", "toxicity", "alignment", "n_scores", "n_flags"]


def period_parts(log: DataFrame, period: str = "hour") -> DataFrame:
    """Counts and sums per period and flag type, from one scan of the log.

    Each evaluation is spread over its flags and counted on the first of them, so what concerns evaluations and what
    concerns flags comes from one aggregation. Parts of different rows add up.
    """
    has_scores = F.size("scores") > 0
    rows = log.select(
        F.date_trunc(period, "timestamp").alias("period_start"), "passed", "latency_ms",
        F.when(has_scores, F.coalesce(F.col("scores")["toxicity"], F.lit(0.0))).alias("toxicity"),
        F.when(has_scores, F.coalesce(F.col("scores")["alignment"], F.lit(0.0))).alias("alignment"),
        F.posexplode_outer("flags").alias("at", "flag"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    timed = first & (F.col("latency_ms") != 0)
    return rows.groupBy("period_start", flag_type(F.col("flag"), 30).alias("flag_type")).agg(
        F.count_if(first).alias("n"), F.count_if(first & F.col("passed")).alias("passed"),
        F.sum(F.when(timed, F.col("latency_ms"))).alias("latency"),
        F.count_if(timed).alias("n_latency"),
        F.sum(F.when(first, F.col("toxicity"))).alias("toxicity"),
        F.sum(F.when(first, F.col("alignment"))).alias("alignment"),
        F.count_if(first & F.col("toxicity").isNotNull()).alias("n_scores"),
        F.count("flag").alias("n_flags"))


def merged_parts(parts: DataFrame, period: str) -> DataFrame:
    """``period_parts`` of several appends or shorter periods, as those of the whole."""
    return parts.groupBy(F.date_trunc(period, "period_start").alias("period_start"), "flag_type").agg(
        *[F.sum(c).alias(c) for c in _SUMS])


def summary_of_parts(parts: DataFrame, period: str) -> DataFrame:
    """Summary row per period; a second, tiny aggregation gathers the flag types of a period into a map."""
    pairs = F.collect_list(F.when(F.col("n_flags") > 0, F.struct("flag_type", "n_flags")))
    out = parts.groupBy("period_start").agg(
        F.sum("n").alias("total_evaluations"), F.sum("passed").alias("passed_count"),
        (F.sum("n") - F.sum("passed")).alias("failed_count"),
        F.coalesce(F.try_divide(F.sum("latency"), F.sum("n_latency")), F.lit(0.0))
        .alias("avg_latency_ms"),
        F.try_divide(F.sum("toxicity"), F.sum("n_scores")).alias("avg_toxicity"),
        F.try_divide(F.sum("alignment"), F.sum("n_scores")).alias("avg_alignment"),
        F.map_from_entries(F.array_sort(pairs)).alias("flag_counts"))
    kind = {"hour": "hourly", "day": "daily", "week": "weekly"}[period]
    step = F.expr(f"interval 1 {period}")
    return out.select("period_start", (F.col("period_start") + step).alias("period_end"),
                      F.lit(kind).alias("period_type"), *out.columns[1:])


def aggregate_periods(log: DataFrame, period: str = "hour") -> DataFrame:
    """Summary row per hour, day or week, from one scan of the log; ``operators.rollup`` keeps them up to date."""
    return summary_of_parts(period_parts(log, period), period)


def aggregate_hourly(log: DataFrame) -> DataFrame:
    return aggregate_periods(log, "hour")


def period_metrics(log: DataFrame, period: str = "day") -> DataFrame:
    """Remaining averages and exact latency percentiles (nearest rank) per period."""
    scores = F.col("scores")
    start = F.date_trunc(period, "timestamp").alias("period_start")
    out = log.groupBy(start).agg(F.avg(scores["hallucination_risk"]).alias("avg_hallucination"),
                                 F.avg(scores["pii_risk"]).alias("avg_pii_risk"))
    ranks = nearest_ranks(log.select(start, "latency_ms"), "period_start", "latency_ms",
                          {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    ranks = ranks.withColumnRenamed("period_start", "_start")
    return out.join(ranks, out["period_start"].eqNullSafe(ranks["_start"]), "left").drop("_start")


def dashboard_series(summaries: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Hourly rows of the last ``hours``, oldest first."""
    return (summaries.filter((F.col("period_type") == "hourly")
                             & (F.col("period_start") >= moment(now - timedelta(hours=hours))))
            .orderBy("period_start")
            .select("period_start", "total_evaluations", "passed_count", "failed_count",
                    F.col("avg_latency_ms").alias("avg_latency")))


def newest(log: DataFrame, size: int | None = None) -> DataFrame:
    """The newest ``size`` evaluations, or all of them, without their texts."""
    slim = log.select("evaluation_id", "timestamp", "passed", "latency_ms", "scores", "flags")
    if size is None:
        return slim
    return page(slim, [("timestamp", True), ("evaluation_id", True)], size)


def _rates(totals: DataFrame) -> DataFrame:
    """Average latency and evaluations per minute from sums and the time range."""
    def seconds(column):
        return F.unix_micros(column) / F.lit(1e6)

    span = seconds(F.col("last")) - seconds(F.col("first"))
    mean = F.try_divide("latency", F.col("total_evaluations"))
    per_minute = F.try_divide(F.col("total_evaluations"), span) * F.lit(60.0)
    return totals.withColumns({
        "average_latency_ms": F.coalesce(mean, F.lit(0.0)),
        "evaluations_per_minute": F.coalesce(per_minute, F.lit(0.0))}
    ).drop("latency", "first", "last")


def metrics_summary(log: DataFrame, size: int | None = None) -> DataFrame:
    """Counts, latency and rate over the whole log, or its newest ``size`` evaluations."""
    return _rates(newest(log, size).agg(
        F.count("*").alias("total_evaluations"), F.count_if("passed").alias("passed_count"),
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.sum("latency_ms").alias("latency"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last")))


def scores_summary(log: DataFrame, size: int | None = None) -> DataFrame:
    """Extremes and averages over the whole log, or its newest ``size`` evaluations, as in ``metrics_summary``."""
    return (newest(log, size).select(F.explode("scores").alias("metric", "value"))
            .filter(F.col("value").isNotNull())
            .groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                   F.avg("value").alias("avg")))


def top_flags(log: DataFrame, limit: int = 10, size: int | None = None) -> DataFrame:
    """Most frequent flag types of the whole log, or of its newest ``size`` evaluations; ties go by name."""
    return (newest(log, size).select(F.explode("flags").alias("flag"))
            .groupBy(flag_type(F.col("flag"), 50).alias("flag")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "flag").limit(limit))


# --- fixed values: exported metrics, column -> (name, type, decimals) ---

EXPORTED = {
    "total_evaluations": ("guardrail_evaluations_total", "counter", 0),
    "passed_count": ("guardrail_evaluations_passed", "counter", 0),
    "failed_count": ("guardrail_evaluations_failed", "counter", 0),
    "average_latency_ms": ("guardrail_latency_avg_ms", "gauge", 2),
    "evaluations_per_minute": ("guardrail_evaluations_per_minute", "gauge", 2),
}
EXPORTED_SCORE = "guardrail_score_{metric}_avg"


def _plain(value: Column, decimals: int) -> Column:
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def prometheus_rows(log: DataFrame, size: int | None = None) -> DataFrame:
    """Rows of metric name, type and value text, from one scan of the whole log, or its newest
    ``size`` evaluations.

    Each evaluation is spread over its scores and counted on the first of them.
    """
    rows = newest(log, size).select("timestamp", "passed", "latency_ms",
                                    F.posexplode_outer("scores").alias("at", "metric", "score"))
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    by_metric = rows.groupBy("metric").agg(
        F.count_if(first).alias("n"), F.count_if(first & F.col("passed")).alias("passed"),
        F.sum(F.when(first, F.col("latency_ms"))).alias("latency"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.avg("score").alias("avg"))
    before, after = EXPORTED_SCORE.split("{metric}")
    average = F.struct(
        F.concat(F.lit(before), F.replace("metric", F.lit("-"), F.lit("_")), F.lit(after))
        .alias("name"), F.lit("gauge").alias("type"), _plain(F.col("avg"), 4).alias("value"))
    totals = _rates(by_metric.agg(
        F.sum("n").alias("total_evaluations"), F.sum("passed").alias("passed_count"),
        (F.sum("n") - F.sum("passed")).alias("failed_count"), F.sum("latency").alias("latency"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_list(F.when(F.col("avg").isNotNull(), average)).alias("averages")))
    fixed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"),
                               _plain(F.coalesce(F.col(c), F.lit(0)), d).alias("value"))
                      for c, (name, kind, d) in EXPORTED.items()])
    return totals.select(F.inline(F.concat(fixed, "averages")))


def history_metrics(log: DataFrame) -> DataFrame:
    scores = F.col("scores")
    out = log.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"),
        F.avg(F.coalesce(scores["toxicity"], F.lit(0.0))).alias("avg_toxicity"),
        F.avg(F.coalesce(scores["alignment"], F.lit(0.0))).alias("avg_alignment"),
        F.coalesce(F.sum(F.size("flags")), F.lit(0)).alias("total_flags"))
    return out.withColumn("pass_rate", _percent(F.col("passed"), F.col("total"))).drop("passed")


def pass_fail_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("passed").agg(F.count("*").alias("count"))


def score_histogram(log: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per metric and bin of [0, 1]; bin 0 holds negative values."""
    bucket = F.least(F.width_bucket("value", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return (log.select(F.explode("scores").alias("metric", "value"))
            .filter(F.col("value").isNotNull())
            .groupBy("metric", bucket.alias("bucket")).agg(F.count("*").alias("count")))


def score_quartiles(log: DataFrame) -> DataFrame:
    """Five-number summary per metric whose scores sum to more than 0."""
    long = log.select(F.explode("scores").alias("metric", "value"))
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(long, "metric", "value", points).filter("total > 0").drop("total")


def flag_value_counts(log: DataFrame) -> DataFrame:
    return (log.select(F.explode("flags").alias("flag")).groupBy("flag")
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "flag"))


def batch_score_table(results: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """One column per score, 0 where missing, and the number of flags."""
    return results.select(row_id, "passed",
                          *[F.coalesce(F.col("scores")[k], F.lit(0.0)).alias(k) for k in keys],
                          F.size("flags").alias("flags_count"))
