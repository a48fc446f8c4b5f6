"""Checks of the streaming jobs (S1-S5): files in, files out, all that is available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import base as B
from checks.registry import check
from wardspark.functions import hashing
from wardspark.session import scratch_path
from wardspark.streaming import jobs


def _as_stream(spark, df, files_per_batch: int | None = None):
    """The rows of ``df`` as a stream of Parquet files."""
    path = scratch_path(spark, "stream-in")
    df.write.parquet(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _drained(spark, stream):
    """What the stream has written once it has read everything."""
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    query = jobs.run_to_files(stream, path, checkpoint)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@check("stream_evaluate", f"""
{B.EVALUATED} SELECT id, evaluation_id, {B.FLAT}, array_to_string(flags, ' | ') AS flags,
  len(flags) = 0 AS passed FROM evaluated""")
def _(spark, sf):
    """The pairs in several micro-batches; the answer is that of the batch job."""
    rows = B.with_vectors(spark, sf).repartition(4)
    out = _drained(spark, jobs.stream_evaluate(_as_stream(spark, rows, 2), B.FULL, B.RULES))
    return out.select("id", "evaluation_id", *B.flat_scores(out),
                      F.array_join("flags", " | ").alias("flags"), "passed")


@check("stream_hourly", f"""
{B.LOG} SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS period_start,
  count(*) AS total_evaluations, count(*) FILTER (passed) AS passed_count,
  count(*) FILTER (NOT passed) AS failed_count,
  round(avg(latency_ms) + 1.23e-8, 6) AS avg_latency_ms, min(latency_ms) AS min_latency_ms,
  max(latency_ms) AS max_latency_ms, round(avg(hal) + 1.23e-8, 6) AS avg_hallucination
FROM log GROUP BY date_trunc('hour', "timestamp")
HAVING date_trunc('hour', "timestamp") + INTERVAL 1 HOUR
  <= (SELECT max("timestamp") - INTERVAL 10 MINUTE FROM log)""")
def _(spark, sf):
    """Hours that the watermark has passed when the log has been read, ten days a micro-batch."""
    rows = B.log(spark, sf).select("timestamp", "passed", "latency_ms", "scores")
    path = scratch_path(spark, "stream-in")
    third = F.least(F.floor((F.dayofmonth("timestamp") - 1) / 10), F.lit(2))
    to, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    for n in range(3):  # whatever files a third has, they are one micro-batch of a stream that goes on
        rows.filter(third == n).write.mode("append").parquet(path)
        stream = jobs.stream_hourly(spark.readStream.schema(rows.schema).parquet(path))
        jobs.run_to_files(stream, to, checkpoint).awaitTermination()
    out = spark.read.schema(stream.schema).parquet(to)
    return out.select(B.stamp("period_start"), "total_evaluations", "passed_count", "failed_count",
                      F.round(F.col("avg_latency_ms") + 1.23e-8, 6).alias("avg_latency_ms"),
                      "min_latency_ms", "max_latency_ms",
                      F.round(F.col("avg_hallucination") + 1.23e-8, 6).alias("avg_hallucination"))


_SECRET = "not a real secret"


@check("stream_alerts", f"""
{B.EVALUATED} SELECT evaluation_id, 'evaluation.failed' AS event, flags[1] AS first_flag,
  round(tox, 6) AS tox, 71 AS signature_length FROM evaluated WHERE len(flags) > 0""")
def _(spark, sf):
    rows = B.evaluated(spark, sf).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    alerts = _drained(spark, jobs.stream_alerts(_as_stream(spark, rows), _SECRET))

    def at(path):
        return F.get_json_object("payload", f"$.{path}")

    return alerts.select("evaluation_id", at("event").alias("event"),
                         at("data.flags[0]").alias("first_flag"),
                         B.six(at("data.scores.toxicity").cast("double")).alias("tox"),
                         F.length("signature").alias("signature_length"))


_INNER, _OUTER = hashing.hmac_pads(_SECRET)


@check("hmac_signature", f"""
WITH {B.PAIRS} SELECT id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}')
  || encode(prompt)))) AS signature FROM pairs""")
def _(spark, sf):
    """The signature of alerts, over texts that both engines hold byte by byte."""
    return B.pairs(spark, sf).select(
        "id", hashing.hmac_sha256(F.col("prompt"), _SECRET).alias("signature"))


@check("batch_completed", f"""
{B.EVALUATED} SELECT 'batch.completed' AS event, conv_id AS batch_id, count(*) AS total,
  count(*) FILTER (len(flags) = 0) AS passed, count(*) FILTER (len(flags) > 0) AS failed
FROM evaluated GROUP BY conv_id""")
def _(spark, sf):
    """Each batch is dealt over several micro-batches."""
    path, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "stream-checkpoint")
    rows = B.evaluated(spark, sf).select("conv_id", "passed")
    sized = rows.join(rows.groupBy("conv_id").agg(F.count("*").alias("size")), "conv_id")
    stream = _as_stream(spark, sized.repartition(4), 1)
    jobs.batch_completed(stream, "conv_id", "size", path, checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("micro_batch")


@check("stream_dedup", f"""
{B.LOG} SELECT DISTINCT sha256(prompt || '|||' || response) AS pair_key FROM log""")
def _(spark, sf):
    """The replayed pairs of the log, each one kept once, over several micro-batches. The delay spans the log, since
    its rows come in any order."""
    rows = B.log_stream(spark, sf, 2).select("timestamp", "prompt", "response")
    return _drained(spark, jobs.stream_dedup(rows, late="60 days")).select("pair_key")


@check("batch_events", f"""
{B.EVALUATED} SELECT CASE WHEN conv_id % 5 = 1 THEN 'batch.incomplete' ELSE 'batch.completed' END AS event,
  conv_id AS batch_id, count(*) AS total, count(*) FILTER (len(flags) = 0) AS passed,
  count(*) FILTER (len(flags) > 0) AS failed FROM evaluated GROUP BY conv_id""")
def _(spark, sf):
    """Every fifth conversation waits for a row that never comes, until its time is out."""
    rows = B.evaluated(spark, sf).select("conv_id", "passed", F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    sizes = rows.groupBy("conv_id").agg((F.count("*") + F.when(F.col("conv_id") % 5 == 1, 1).otherwise(0)).alias("size"))
    path = scratch_path(spark, "stream-in")
    rows.join(sizes, "conv_id").repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    # two rows of a day later let the time of the others run out; their own batches stay open
    later = spark.createDataFrame([(-n, True, 9) for n in (1, 2)], "conv_id long, passed boolean, size long")
    for _ in range(2):
        later.withColumn("timestamp", F.lit("2024-01-02").cast("timestamp")).select(schema.names).coalesce(1).write.mode(
            "append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = _drained(spark, jobs.batch_events(stream, "conv_id", "size"))
    return out.select("event", F.col("conv_id").alias("batch_id"), "total", "passed", "failed")
