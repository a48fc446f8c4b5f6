"""Mergeable parts of a growing log against aggregations of the whole."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardspark.operators import metrics, rollup
from wardspark.session import scratch_path

LOG = ("evaluation_id string, timestamp timestamp, passed boolean, scores map<string,double>, flags array<string>, "
       "latency_ms double")


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for n in range(1500):
        scores = rng.choice([{}, None, {"toxicity": n % 7 / 8}, {"alignment": 0.5, "pii_risk": n % 3 / 4},
                             {"hallucination_risk": n % 5 / 8, "toxicity": None}])
        rows.append((f"e{n}", datetime(2024, 1, 29) + timedelta(minutes=rng.randrange(12 * 24 * 60)), n % 3 > 0, scores,
                     rng.choice([[], ["High: 1"], ["High: 2", "PII in prompt: 0.3"], ["x" * 40, "High: 9"]]),
                     rng.choice([None, 0.0, 5.0, 5.0, float(n % 90)])))
    return spark.createDataFrame(rows, LOG).repartition(3)


def rows_of(df):
    return sorted(repr([[round(v, 9) if isinstance(v, float) else v for v in (
        sorted(x.items()) if isinstance(x, dict) else [x])] for x in r]) for r in df.collect())


def test_parts_equal_the_whole_after_late_rows(spark, log):
    path = scratch_path(spark, "parts")
    for n in range(3):  # every append has rows of every day
        rollup.append_parts(log.filter(F.pmod(F.xxhash64("evaluation_id"), F.lit(3)) == n), path)
    for compacted in (False, True):
        if compacted:
            before = rollup.read_parts(spark, path).count()
            rollup.compact(spark, path)
            assert rollup.read_parts(spark, path).count() < before
        parts = rollup.read_parts(spark, path)
        for period in ("hour", "day", "week"):
            assert rows_of(rollup.summaries(parts, period)) == rows_of(metrics.aggregate_periods(log, period))
            assert rows_of(rollup.period_metrics(parts, period)) == rows_of(metrics.period_metrics(log, period))


def test_nothing(spark, log):
    path = scratch_path(spark, "parts")
    rollup.append_parts(log.filter("false"), path)
    rollup.append_parts(log.limit(5), path)
    parts = rollup.read_parts(spark, path)
    assert rollup.summaries(parts, "week").agg(F.sum("total_evaluations")).head()[0] == 5
    assert rollup.summaries(parts.filter("false"), "day").count() == 0
