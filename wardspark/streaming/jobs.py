"""Streaming jobs; the scoring is the same projection as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardspark.config import EvalConfig
from wardspark.functions import hashing
from wardspark.plans.batch import batch_summary
from wardspark.plans.evaluate import PairColumns, evaluate

LATE = "10 minutes"  # how late an evaluation may arrive
REMEMBERED = 200_000  # keys that a task remembers; then it forgets all and goes on


def stream_evaluate(pairs: DataFrame, config: EvalConfig = EvalConfig(), rule_list=(),
                    names: PairColumns = PairColumns()) -> DataFrame:
    """Stateless scoring of a stream of pairs."""
    return evaluate(pairs, config, rule_list, names)


def stream_hourly(results: DataFrame, late: str = LATE) -> DataFrame:
    """Hourly counts, latency and score extremes; an hour appears once it can no longer
    change. State is one row per open hour."""
    scores = F.col("scores")
    out = (results.withWatermark("timestamp", late)
           .groupBy(F.window("timestamp", "1 hour"))
           .agg(F.count("*").alias("total_evaluations"),
                F.count_if("passed").alias("passed_count"),
                F.count_if(~F.col("passed")).alias("failed_count"),
                F.avg("latency_ms").alias("avg_latency_ms"),
                F.min("latency_ms").alias("min_latency_ms"),
                F.max("latency_ms").alias("max_latency_ms"),
                F.avg(scores["hallucination_risk"]).alias("avg_hallucination")))
    return out.select(F.col("window.start").alias("period_start"),
                      F.col("window.end").alias("period_end"),
                      *[c for c in out.columns if c != "window"])


def stream_alerts(results: DataFrame, secret: str | None = None) -> DataFrame:
    """One ``evaluation.failed`` event per failed row, signed if a secret is given."""
    data = F.struct(F.col("evaluation_id").alias("id"), "timestamp", "passed", "flags", "scores")
    failed = results.filter(~F.col("passed"))
    out = failed.select("evaluation_id", F.lit("evaluation.failed").alias("event"),
                        F.to_json(F.struct(F.lit("evaluation.failed").alias("event"),
                                           data.alias("data"))).alias("payload"))
    if secret is None:
        return out
    return out.withColumn("signature", F.concat(
        F.lit("sha256="), hashing.hmac_sha256(F.col("payload"), secret)))


def batch_completed_events(results: DataFrame, batch: str, *also: str) -> DataFrame:
    """One ``batch.completed`` event per batch; ``also`` are columns that a batch has one value of."""
    return batch_summary(results, batch, also=also).select(
        *also,
        F.lit("batch.completed").alias("event"), F.col(batch).alias("batch_id"), "total",
        F.col("passed_count").alias("passed"), F.col("failed_count").alias("failed"))


def batch_completed(results: DataFrame, batch: str, size: str, path: str, checkpoint: str,
                    started: str | None = None, late: str = LATE) -> StreamingQuery:
    """Writes the event of a batch, with its full totals, once all its rows have come.

    ``size`` is the column with the number of rows of the batch. State is one row of counts per
    batch. With ``started``, the time the batch was sent (one value per batch), the state of a
    batch is dropped when the watermark has passed it. A repeated micro-batch replaces its own
    events.
    """
    def write(rows: DataFrame, number: int) -> None:
        (rows.filter(F.col("total") == F.col(size)).drop(size, *([started] if started else []))
         .write.mode("overwrite").parquet(f"{path}/micro_batch={number}"))

    if started:
        results = results.withWatermark(started, late)
    totals = batch_completed_events(results, batch, size, *([started] if started else []))
    return (totals.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _collapsed(key: str, timestamp: str):
    """Keeps the first row of each key that a task has seen, and the latest row of each Arrow batch, which holds the
    watermark up. What is kept too much, the state behind drops."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, bool)
            for n, value in enumerate(batch.column(key).to_pylist()):
                if value not in seen:
                    seen.add(value)
                    keep[n] = True
            times = pc.fill_null(batch.column(timestamp).cast(pa.int64()), np.iinfo(np.int64).min)
            keep[int(np.argmax(times.to_numpy()))] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            yield batch.filter(pa.array(keep))
    return run


def stream_dedup(pairs: DataFrame, timestamp: str = "timestamp", late: str = LATE,
                 names: PairColumns = PairColumns()) -> DataFrame:
    """The first of equal pairs; a key is forgotten when the watermark has passed it.

    Copies collapse per task before the keyed state, so a pair that makes up a third of a stream is shuffled once a
    task and micro-batch, and not once a row.
    """
    key = hashing.pair_key(F.col(names.prompt), F.col(names.response))
    keyed = pairs.withColumn("pair_key", key)
    return (keyed.mapInArrow(_collapsed("pair_key", timestamp), keyed.schema).withWatermark(timestamp, late)
            .dropDuplicatesWithinWatermark(["pair_key"]))


_COUNTS = "total long, passed long, size long"


def _counted(batch: str, size: str, timestamp: str):
    """Rows of a task counted by batch, before anything is shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield (rows.groupby(batch, as_index=False, dropna=False, sort=False)
                       .agg(total=("passed", "size"), passed=("passed", "sum"), size=(size, "max"),
                            **{timestamp: (timestamp, "max")}))
    return run


def _batch_state(batch: str, wait_ms: int, timestamp: str):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def event(name: str, total: int, passed: int) -> pd.DataFrame:
            return pd.DataFrame({"event": [name], batch: [key[0]], "total": [total], "passed": [passed],
                                 "failed": [total - passed]})

        if state.hasTimedOut:
            total, passed, _, _ = state.get
            state.remove()
            yield event("batch.incomplete", total, passed)
            return
        total, passed, size, last = state.get if state.exists else (0, 0, 0, 0)
        for rows in parts:
            total, passed = total + int(rows["total"].sum()), passed + int(rows["passed"].sum())
            size = max(size, int(rows["size"].max()))
            last = max(last, int(rows[timestamp].max().timestamp() * 1000))
        if total >= size:
            if state.exists:
                state.remove()
            yield event("batch.completed", total, passed)
            return
        state.update((total, passed, size, last))
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))
    return run


def batch_events(results: DataFrame, batch: str, size: str, timestamp: str = "timestamp",
                 wait_seconds: int = 3600, late: str = LATE) -> DataFrame:
    """``batch.completed`` when all rows of a batch have come, or ``batch.incomplete`` with the totals so far once the
    watermark is ``wait_seconds`` past its last row.

    ``size`` is the column with the number of rows of the batch. Rows are counted per task first; state is one row of
    counts per open batch, and a timer of event time ends it. Rows that come after that, and aren't too late for the
    watermark, are a batch of their own that can't be complete.
    """
    kind = results.schema[batch].dataType.simpleString()
    slim = results.select(batch, F.col("passed").cast("int").alias("passed"), F.col(size).cast("long").alias(size),
                          timestamp)
    counted = slim.mapInPandas(_counted(batch, size, timestamp),
                               f"`{batch}` {kind}, {_COUNTS}, `{timestamp}` timestamp")
    return counted.withWatermark(timestamp, late).groupBy(batch).applyInPandasWithState(
        _batch_state(batch, 1000 * wait_seconds, timestamp),
        f"event string, `{batch}` {kind}, total long, passed long, failed long",
        _COUNTS + ", last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows available now to Parquet files."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
