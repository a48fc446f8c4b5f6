"""Summaries of a growing log that are never computed twice.

Every append to the log adds the partial aggregates of its own rows to a table: counts and sums per hour and flag type,
sums of the further scores per hour, and how often each latency occurs per hour. Parts add up, so a late row is one more
part of its hour, days and weeks are sums of hours, and exact percentiles come from the counted values. A
summary reads the parts and not the log. ``compact`` adds up the parts of each day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators import metrics
from wardspark.operators.ranking import nearest_ranks
from wardspark.session import cut_lineage

_KEYS = ["kind", "dt", "period_start", "flag_type", "latency_ms"]
_SCORES = {"avg_hallucination": "hallucination_risk", "avg_pii_risk": "pii_risk"}
_FURTHER = [f"{part}_{name}" for name in _SCORES for part in ("sum", "n")]
_ADDED = {**{c: "bigint" for c in ("n", "passed", "n_latency", "n_scores", "n_flags")},
          **{c: "double" for c in ("latency", "toxicity", "alignment")},
          **{c: "bigint" if c.startswith("n_") else "double" for c in _FURTHER}}
SCHEMA = ("period_start timestamp, flag_type string, latency_ms double, "
          + ", ".join(f"{c} {kind}" for c, kind in _ADDED.items()) + ", kind string, dt date")


def parts_of(log: DataFrame) -> DataFrame:
    """The partial aggregates of some rows of the log; ``kind`` is ``flags``, ``scores`` or ``latency``."""
    def shaped(df: DataFrame, kind: str) -> DataFrame:
        def column(name: str, of: str):
            return (F.col(name) if name in df.columns else F.lit(None)).cast(of).alias(name)

        return df.select("period_start", column("flag_type", "string"), column("latency_ms", "double"),
                         *[column(c, of) for c, of in _ADDED.items()], F.lit(kind).alias("kind"),
                         F.to_date("period_start").alias("dt"))

    hour = F.date_trunc("hour", "timestamp").alias("period_start")
    scores = log.groupBy(hour).agg(*[agg(F.col("scores")[key]).alias(f"{part}_{name}")
                                     for name, key in _SCORES.items()
                                     for part, agg in (("sum", F.sum), ("n", F.count))])
    latency = log.filter("latency_ms IS NOT NULL").groupBy(hour, "latency_ms").agg(F.count("*").alias("n"))
    return (shaped(metrics.period_parts(log, "hour"), "flags").unionByName(shaped(scores, "scores"))
            .unionByName(shaped(latency, "latency")))


def append_parts(log: DataFrame, path: str) -> None:
    """Adds the parts of new rows of the log; each day of a kind is one file, or more if it is large."""
    (parts_of(log).hint("rebalance", "kind", "dt").write.mode("append").partitionBy("kind", "dt").parquet(path))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def compact(spark: SparkSession, path: str) -> None:
    """Adds up the parts of each hour, by way of the shared folder; readers of this moment should wait."""
    added = cut_lineage(read_parts(spark, path).groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _ADDED]))
    (added.hint("rebalance", "kind", "dt").write.mode("overwrite").partitionBy("kind", "dt").parquet(path))


def summaries(parts: DataFrame, period: str = "hour") -> DataFrame:
    """What ``metrics.aggregate_periods`` gives for the whole log."""
    flags = parts.filter("kind = 'flags'")
    return metrics.summary_of_parts(metrics.merged_parts(flags, period), period)


def period_metrics(parts: DataFrame, period: str = "day") -> DataFrame:
    """What ``metrics.period_metrics`` gives for the whole log."""
    start = F.date_trunc(period, "period_start").alias("period_start")
    out = parts.filter("kind = 'scores'").groupBy(start).agg(*[
        F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(name) for name in _SCORES])
    ranks = nearest_ranks(parts.filter("kind = 'latency'").select(start, "latency_ms", "n"), "period_start",
                          "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, F.col("n"))
    ranks = ranks.withColumnRenamed("period_start", "_start")
    return out.join(ranks, out["period_start"].eqNullSafe(ranks["_start"]), "left").drop("_start")
