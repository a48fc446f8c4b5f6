"""Streaming jobs over several triggers."""

import hashlib
import time

from pyspark.sql import functions as F

from wardspark.session import scratch_path
from wardspark.streaming import jobs


def as_stream(spark, parts, schema):
    """One file per part, in order, one per trigger."""
    path = scratch_path(spark, "in")
    for n, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema)
        for name in ("timestamp", "started"):
            if name in df.columns:
                df = df.withColumn(name, F.col(name).cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream):
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    query = jobs.run_to_files(stream, path, checkpoint)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query


def test_hot_pair_is_shuffled_once_a_task(spark):
    """A third of the rows are one pair; all copies but a few are gone before the keyed state."""
    def rows(trigger):
        return [(f"2024-01-01 00:0{trigger}:{n % 60:02}", *(("hot", "pair") if n % 3 == 0 else (f"p{n}-{trigger}", "r")))
                for n in range(3000)]

    stream = as_stream(spark, [rows(t) for t in range(4)], "timestamp string, prompt string, response string")
    out, query = drained(spark, jobs.stream_dedup(stream, late="1 hour"))
    wanted = {("hot", "pair")} | {(f"p{n}-{t}", "r") for t in range(4) for n in range(3000) if n % 3}
    got = [(r.prompt, r.response) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    dropped = sum(p["stateOperators"][0]["customMetrics"]["numDroppedDuplicateRows"]
                  for p in query.recentProgress if p["stateOperators"])
    assert dropped <= 12  # once a later trigger, and the latest row of a batch
    assert out.filter("prompt = 'hot'").head().pair_key == hashlib.sha256(b"hot|||pair").hexdigest()


def test_null_pairs_and_repeated_triggers(spark):
    parts = [[("2024-01-01 00:00:00", None, "r"), ("2024-01-01 00:00:01", None, "r")],
             [("2024-01-01 00:00:02", "", "r"), ("2024-01-01 00:00:02", "x", None)]]
    out, _ = drained(spark, jobs.stream_dedup(as_stream(
        spark, parts, "timestamp string, prompt string, response string"), late="1 hour"))
    assert out.count() == 2  # a null text is an empty one


def test_complete_late_and_never_complete_batches(spark):
    schema = "timestamp string, batch string, passed boolean, size long"
    first = [("2024-01-01 00:00:00", "whole", n % 2 == 0, 300) for n in range(200)]
    first += [("2024-01-01 00:00:00", "never", True, 9)] * 4 + [("2024-01-01 00:00:00", None, True, 1)]
    second = [("2024-01-01 00:30:00", "whole", False, 300)] * 100 + [("2024-01-01 00:30:00", "slow", True, 2)]
    # two hours later the time of "never" is out; "slow" comes in time
    third = [("2024-01-01 01:20:00", "slow", True, 2), ("2024-01-01 02:30:00", "last", True, 5)]
    fourth, fifth = [("2024-01-01 02:31:00", "last", True, 5)], [("2024-01-01 02:32:00", "never", True, 9)]
    stream = as_stream(spark, [first, second, third, fourth, fifth], schema)
    out, _ = drained(spark, jobs.batch_events(stream, "batch", "size", wait_seconds=3600))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([("batch.completed", "whole", 300, 100, 200), ("batch.completed", "slow", 2, 2, 0),
                          ("batch.completed", None, 1, 1, 0), ("batch.incomplete", "never", 4, 4, 0)], key=repr)


def test_the_log_is_streamed_without_a_copy(spark, monkeypatch):
    """Micro-batches are made of the log's own files, so a log of any size is neither dealt out nor written again."""
    import __spark_entry__ as entry
    from checks import streams

    made = []

    def noted(session, label):
        made.append(label)
        return scratch_path(session, label)

    monkeypatch.setattr(streams, "scratch_path", noted)
    assert entry.queries()["stream_dedup"](spark, "/root/testdata/sf0.001").count() == 34
    assert made == ["stream-out", "stream-checkpoint"]


def test_hours_come_from_files_of_many_tasks(spark, monkeypatch):
    """Each ten days are one micro-batch, however many tasks wrote them."""
    import __spark_entry__ as entry
    from checks import base, streams

    made = []

    def noted(session, label):
        made.append((label, scratch_path(session, label)))
        return made[-1][1]

    def log(session, sf):
        seconds = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 400)")
        return session.range(0, 6000, 1, 4).select(
            seconds.alias("timestamp"), (F.col("id") % 2 == 0).alias("passed"), F.col("id").cast("double").alias("latency_ms"),
            F.create_map(F.lit("hallucination_risk"), F.lit(0.5)).alias("scores")).repartition(4)

    monkeypatch.setattr(streams, "scratch_path", noted)
    monkeypatch.setattr(base, "log", log)
    hours = entry.queries()["stream_hourly"](spark, "").collect()
    assert len(hours) == 666 and all(r.total_evaluations == 9 for r in hours)
    paths = dict(made)
    assert len(spark.read.parquet(paths["stream-in"]).inputFiles()) > 3
