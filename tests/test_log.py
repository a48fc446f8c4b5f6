"""Ranking, log queries, keyed tables, retention and streaming state."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.operators import keyed, metrics, projections, report
from wardspark.operators import log as L
from wardspark.operators.ranking import quantiles, running_total
from wardspark.session import scratch_path
from wardspark.sources import results
from wardspark.streaming import jobs

LOG = ("evaluation_id string, timestamp timestamp, prompt string, response string, passed boolean, "
       "scores map<string,double>, flags array<string>, latency_ms double, source string, "
       "user_id string")
START = datetime(2024, 3, 1)


def log(spark, n=10, step=timedelta(minutes=7)):
    rows = [(f"eval_{i:04d}", START + step * i, f"prompt {i}", f"Response {i}", i < n * 7 // 10,
             {"toxicity": i / n} if i % 4 else {}, [] if i < n // 2 else [f"kind {i % 3}: 0.5"],
             float(i % 3), "api" if i % 2 else "cli", None if i % 5 == 0 else f"u{i % 2}")
            for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_statistics(spark):
    r = metrics.statistics(log(spark)).head()
    assert (r.total, r["passed"], r.failed, r.pass_rate) == (10, 7, 3, 70.0)
    empty = metrics.statistics(log(spark), end="2000-01-01").head()
    assert (empty.total, empty.pass_rate, empty.avg_latency_ms) == (0, 0.0, 0.0)


def test_list_page_and_total(spark):
    rows, total = L.list_evaluations(log(spark), limit=3, offset=1, passed=True)
    assert [r.evaluation_id for r in rows.collect()] == [f"eval_{i:04d}" for i in (5, 4, 3)]
    assert total.head()[0] == 7
    rows, _ = L.list_evaluations(log(spark), order_by="nonsense", descending=False, limit=2)
    assert [r.evaluation_id for r in rows.collect()] == ["eval_0000", "eval_0001"]


def test_far_page_equals_near_page(spark, monkeypatch):
    order = L.NEWEST_FIRST
    near = L.page(log(spark, 60), order, 10, 25).collect()
    monkeypatch.setattr(L, "TOP_ROWS", 0)
    far = L.page(log(spark, 60), order, 10, 25).orderBy(F.desc("timestamp"), "evaluation_id").collect()
    assert near == far and len(near) == 10


def test_search_is_a_like(spark):
    assert L.search_evaluations(log(spark), "RESPONSE 3").count() == 1
    assert L.search_evaluations(log(spark), "prompt _").count() == 10


def test_preview(spark):
    df = log(spark, 1).withColumn("prompt", F.repeat(F.lit("x"), 101))
    r = L.history_view(df).head()
    assert r.prompt == "x" * 100 + "..." and r.response == "Response 0"


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_running_total_equals_a_plain_sum(spark, hot):
    """Also when one group holds most of the rows."""
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.randint(0, 50),
             rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "n int, g string, o int, w int").repartition(5)
    got = running_total(df, ["g"], [("o", True), "n"], "total", F.col("w"), 8)
    seen, expected = {}, {}
    for n, g, o, w in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[g] = seen.get(g, 0) + w
        expected[n] = seen[g]
    assert {r.n: r.total for r in got.collect()} == expected


def test_quantiles_equal_numpy(spark):
    rng = random.Random(9)
    data = {g: [0.0] * zeros + [round(rng.uniform(-1, 1), 3) for _ in range(size)]
            for g, zeros, size in (("x", 500, 300), ("y", 0, 1), ("z", 3, 4), ("w", 0, 999))}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    points = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    for r in quantiles(df, "g", "v", points).collect():
        for name, q in points.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], q), abs=1e-12), (r.g, name)


def test_hourly(spark):
    out = metrics.aggregate_hourly(log(spark)).orderBy("period_start").collect()
    assert [r.total_evaluations for r in out] == [9, 1]
    first = out[0]
    assert (first.passed_count, first.failed_count) == (7, 2)
    assert first.flag_counts == {"kind 0": 1, "kind 1": 1, "kind 2": 2}
    # zero latencies are left out; rows without scores are left out of the score averages
    assert first.avg_latency_ms == pytest.approx(np.mean([i % 3 for i in range(9) if i % 3]))
    assert first.avg_toxicity == pytest.approx(np.mean([i / 10 for i in range(9) if i % 4]))
    assert first.avg_alignment == 0.0
    assert out[1].avg_latency_ms == 0.0


def test_flag_types(spark):
    df = spark.createDataFrame([("a: b: c",), ("x" * 60,)], "f string")
    assert [r[0] for r in df.select(metrics.flag_type(F.col("f"), 50)).collect()] == ["a", "x" * 50]


def test_metrics_summary_takes_the_newest(spark):
    r = metrics.metrics_summary(log(spark), 4).head()
    assert (r.total_evaluations, r.passed_count) == (4, 1)
    assert r.evaluations_per_minute == pytest.approx(4 / 21)
    assert metrics.metrics_summary(log(spark), 1).head().evaluations_per_minute == 0.0


def test_flags_and_scores_of_the_newest(spark):
    """Over the same rows as the counts."""
    rows = log(spark)
    kept = rows.orderBy(F.desc("timestamp")).limit(4)
    for found, wanted in ((metrics.top_flags(rows, 5, 4), metrics.top_flags(kept, 5)),
                          (metrics.scores_summary(rows, 4), metrics.scores_summary(kept))):
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_histogram_bounds(spark):
    df = spark.createDataFrame([({"m": v},) for v in (-0.2, 0.0, 0.05, 0.999, 1.0)],
                               "scores map<string,double>")
    got = {r.bucket: r["count"] for r in metrics.score_histogram(df).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 20: 2}


def test_prometheus_decimals(spark):
    got = {r.name: r.value for r in metrics.prometheus_rows(log(spark)).collect()}
    assert got["guardrail_evaluations_total"] == "10"
    assert got["guardrail_latency_avg_ms"] == "0.90"


def test_status_tables(spark):
    df = spark.createDataFrame([("toxicity", 0.7), ("toxicity", 0.3), ("alignment", 0.7),
                                ("other", 0.4)], "m string, v double")
    rows = df.select(projections.metric_status(F.col("m"), F.col("v"), "report").alias("r"),
                     projections.metric_status(F.col("m"), F.col("v"), "cards").alias("c"))
    assert [tuple(r) for r in rows.collect()] == [
        ("orange", "red"), ("green", "green"), ("orange", "green"), ("blue", "orange")]


def test_report(spark):
    df = log(spark).filter("evaluation_id in ('eval_0001', 'eval_0009')")
    good, bad = [r.report for r in report.report_rows(df, "now").orderBy("evaluation_id").collect()]
    assert "PASSED" in good and "No Issues Detected" in good and "**Toxicity**: 0.100" in good
    assert "- kind 0: 0.5" in bad and "harmful content" in bad


def test_report_sections(spark):
    detailed = """named_struct(
        'toxicity', named_struct('details', named_struct('categories', map('insult', 0.25D))),
        'pii', named_struct('details', named_struct('matches_by_category',
            map('phone_us', array('a', 'b')))),
        'prompt_injection', named_struct('details', named_struct(
            'categories_detected', array('jailbreak', 'delimiter'), 'risk_level', 'high')),
        'custom_rules', named_struct('details', named_struct('triggered_rules',
            array(named_struct('name', 'Prices', 'action', 'block')))))"""
    df = spark.range(2).select(F.expr(f"if(id = 0, {detailed}, null)").alias("detailed_results"))
    found, none = [r[0] for r in df.select(report.sections(df)).collect()]
    assert none == "" and found == "\n".join([
        "### Pii", "- **Phone Us**: 2 found",
        "### Prompt Injection", "- **Detected patterns**: jailbreak, delimiter",
        "- **Severity**: high",
        "### Toxicity", "| Category | Score |", "|---|---|", "| Insult | 0.250 |",
        "### Custom Rules", "- **Prices**: block"])
    df = log(spark, 1).withColumn("detailed_results", F.expr(detailed))
    text = report.report_rows(df, "now", detailed="detailed_results").head().report
    assert "## Detailed Analysis\n### Pii" in text and "block\n\n## Recommendations" in text


def test_validation(spark):
    long = "x" * (projections.MAX_PROMPT + 1)
    df = spark.createDataFrame([(" a ", "b"), ("", "b"), (long, "b"), ("a", None),
                                (" " * projections.MAX_PROMPT, "b")], "prompt string, response string")
    got = [(r.reject_reason, r.prompt[:1] if r.prompt else r.prompt)
           for r in projections.validate_pairs(df).collect()]
    assert got == [(None, "a"), ("prompt is empty", ""), ("prompt is too long", "x"),
                   ("response is empty", "a"), (None, "")]


def test_retention_on_disk(spark):
    path = scratch_path(spark, "log")
    results.append_evaluations(log(spark, 100, timedelta(hours=3)), path)
    now = START + timedelta(days=10, hours=10)
    gone = results.expire_days(spark, path, now, 3)
    kept = results.read_log(spark, path)
    cutoff = now - timedelta(days=3)
    expected = sum(START + timedelta(hours=3) * i >= cutoff for i in range(100))
    assert kept.count() == expected and gone == 100 - expected
    assert kept.agg(F.min("timestamp")).head()[0] >= cutoff
    assert results.expire_days(spark, path, now, 3) == 0


def test_date_filter_prunes_partitions(spark):
    path = scratch_path(spark, "log")
    results.append_evaluations(log(spark, 100, timedelta(hours=3)), path)
    kept = L.filtered(results.read_log(spark, path), start=START + timedelta(days=2),
                      end=START + timedelta(days=3))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert kept.count() == 9


def changes(seed, ops, n=400, keys=6):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", rng.choice(ops), i, rng.random() < 0.4)
            for i in range(n)]


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 12), (3, 25)])
def test_rules_after_random_changes(spark, seed, n):
    history = changes(seed, ["save", "save", "toggle", "delete"], n)
    state = {}
    for key, op, i, flag in history:
        if op == "save":
            state[key] = (f"p{i}", state[key][1] if key in state else True)
        elif op == "toggle" and key in state:
            state[key] = (state[key][0], flag)
        elif op == "delete":
            state.pop(key, None)
    rows = [(k, op, "n", None, "regex", f"p{i}", 0.5, "flag", "both", 0, flag,
             START + timedelta(seconds=i), i) for k, op, i, flag in history]
    df = spark.createDataFrame(rows, (
        "rule_id string, op string, name string, description string, rule_type string, "
        "pattern string, severity double, action string, apply_to string, priority int, "
        "enabled boolean, changed_at timestamp, seq long"))
    got = {r.rule_id: (r.pattern, r.enabled) for r in keyed.rules_current(df).collect()}
    assert got == state


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 9), (3, 14), (4, 20), (5, 30)])
def test_configs_after_random_changes(spark, seed, n):
    history = changes(seed, ["save", "save", "activate", "delete"], n, 4)
    state = {}
    for key, op, i, flag in history:
        if op == "activate" or (op == "save" and flag):
            state = {k: (v[0], False, i) for k, v in state.items()}
        if op == "save":
            state[key] = (f"c{i}", flag, i)
        elif op == "activate" and key in state:
            state[key] = (state[key][0], True, i)
        elif op == "delete":
            state.pop(key, None)
    rows = [(k, op, f"c{i}", None, flag if op == "save" else None, START + timedelta(seconds=i), i)
            for k, op, i, flag in history]
    df = spark.createDataFrame(rows, "name string, op string, config_data string, description string, "
                                     "activate boolean, changed_at timestamp, seq long")
    got = {r.name: (r.config_data, r.is_active, r.updated_at)
           for r in keyed.configs_current(df).collect()}
    assert got == {k: (c, a, START + timedelta(seconds=i)) for k, (c, a, i) in state.items()}


def test_late_rows_do_not_reopen_an_hour(spark):
    """A row older than the watermark is dropped, one inside it is counted."""
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    checkpoint = scratch_path(spark, "cp")
    schema = "timestamp timestamp, passed boolean, latency_ms double, scores map<string,double>"

    def arrive(*minutes):
        rows = [(START + timedelta(minutes=m), True, 1.0, {}) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        jobs.run_to_files(jobs.stream_hourly(stream), out, checkpoint).awaitTermination()
        return {r.period_start: r.total_evaluations for r in spark.read.parquet(out).collect()}

    first, second = START, START + timedelta(hours=1)
    assert arrive(5, 65) == {}          # watermark at 0:55
    assert arrive(58, 69) == {}         # 0:58 is late but inside it; watermark at 0:59
    assert arrive(75) == {first: 2}     # watermark at 1:05 closes the first hour
    assert arrive(30, 140) == {first: 2, second: 3}  # 0:30 comes too late


def test_stream_dedup(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    schema = "timestamp timestamp, prompt string, response string"
    rows = [(START, "a", "b"), (START, "a", "b"), (START, "a", "c"), (START, "ab", "")]
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = jobs.stream_dedup(spark.readStream.schema(schema).parquet(path))
    jobs.run_to_files(stream, out, scratch_path(spark, "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("slices", [1, 2, 5, 64])
def test_running_total_with_nulls_and_directions(spark, slices):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "a"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "n int, g string, o int, s string").repartition(3)
    order = [("o", True), "s", ("n", True)]
    got = {r.n: r.at for r in running_total(df, ["g"], order, "at", slices=slices).collect()}
    # nulls are the smallest values: last when descending, first when ascending
    wanted, seen = {}, {}
    for n, g, _, _ in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[3] is not None, r[3] or "", -r[0])):
        seen[g] = seen.get(g, 0) + 1
        wanted[n] = seen[g]
    assert got == wanted


def test_ranking_starts_no_job_before_it_is_asked_for(spark):
    rows = log(spark)
    context = spark.sparkContext
    context.setJobGroup("lazy", "plans only")
    L.timeline(rows, "source")
    L.page(rows, L.NEWEST_FIRST, 10, 20_000)
    metrics.score_quartiles(rows)
    metrics.period_metrics(rows, "week")
    assert list(context.statusTracker().getJobIdsForGroup("lazy")) == []
    context.setJobGroup("", "")
    assert running_total(rows.filter("false"), [], ["evaluation_id"], "n").count() == 0


def test_full_days_are_written_where_they_are(spark):
    """Tasks with many rows of a day write them themselves, so that no text is shuffled; quiet days are still balanced."""
    made = spark.range(0, 40_000, 1, 2).select(
        F.concat(F.lit("eval_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24)).alias("evaluation_id"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval((F.col("id") % 2).cast("int"))).alias("timestamp"),
        F.concat(F.lit("p"), "id").alias("prompt"), F.lit("r").alias("response"), F.lit(True).alias("passed"),
        F.create_map(F.lit("toxicity"), F.lit(0.5)).alias("scores"), F.array(F.lit("f")).alias("flags"))
    path = scratch_path(spark, "log")
    results.append_evaluations(made, path)
    stored = results.read_log(spark, path)
    assert len(stored.inputFiles()) == 4 and all(".zstd." in f for f in stored.inputFiles())
    assert stored.count() == 40_000 == stored.select("prompt").distinct().count()
    row = stored.filter("prompt = 'p7'").head()
    assert results.find_evaluation(spark, path, row.evaluation_id).count() == 1
    assert stored.filter("prompt_hash <> sha2(prompt, 256) OR metadata <> '{}' OR source <> 'api'").count() == 0
    quiet = scratch_path(spark, "log")
    results.append_evaluations(made.repartition(8), quiet)
    days = {f.rsplit("dt=", 1)[1] for f in results.read_log(spark, quiet).inputFiles()}
    assert len(days) == 2 and results.read_log(spark, quiet).count() == 40_000
