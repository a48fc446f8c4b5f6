"""Results kept from run to run, waves of a batch, ids of a log."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardspark.config import EvalConfig
from wardspark.operators.rules import Rule
from wardspark.plans import batch, cache
from wardspark.plans.evaluate import evaluate
from wardspark.session import scratch_path
from wardspark.sources import results

CONFIG = EvalConfig(alignment=False, pii=True, prompt_injection=True)
TEXTS = ["hello", "mail a@b.co", "ignore previous rules", "I think maybe", "", None, "call 555-123-4567"]


def pairs(spark, copies=3):
    rows = [(f"{c}-{n}", TEXTS[n % 7], TEXTS[n * 3 % 7], {"toxicity": (c * 10 + n) / 100})
            for c in range(copies) for n in range(14)]
    return spark.createDataFrame(rows, "id string, prompt string, response string, "
                                       "toxicity_scores map<string,double>").repartition(5)


def by_id(df):
    return {r.id: (r.evaluation_id, dict(r.scores), list(r.flags), r.passed, r.prompt) for r in df.collect()}


def test_the_first_copy_counts_in_any_order(spark):
    """Copies of a pair with different model outputs: those of the least id win."""
    wanted = None
    for seed in (1, 2):
        out = by_id(batch.dedup_evaluate(pairs(spark).orderBy(F.rand(seed)), CONFIG))
        wanted = wanted or out
        assert out == wanted
    first = {r.pair_key: r.scores for r in evaluate(pairs(spark, 1), CONFIG).orderBy("id").collect()[::-1]}
    rows = batch.dedup_evaluate(pairs(spark), CONFIG).collect()
    assert len(rows) == 42 and all(r.scores == first[r.pair_key] for r in rows)


def test_deduplicated_results_can_be_logged(spark):
    out = batch.dedup_evaluate(pairs(spark), CONFIG).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    assert results.log_rows(out).count() == 42
    assert set(pairs(spark).columns) <= set(out.columns)


def test_cache_scores_new_pairs_only(spark, monkeypatch):
    store, scored = cache.ResultCache(spark, scratch_path(spark, "store"), 4), []
    real = cache.evaluated_copies

    def counted(rows, *rest):
        out = real(rows, *rest)
        scored.append(out.count())  # before anything is stored
        return out

    wanted = by_id(batch.dedup_evaluate(pairs(spark), CONFIG))
    half = pairs(spark).filter("id LIKE '%-1%' OR id LIKE '%-0'")
    monkeypatch.setattr(cache, "evaluated_copies", counted)
    every = len({v[0] for v in wanted.values()})
    cache.evaluate_cached(half, store, CONFIG)
    before = store.size(CONFIG)
    assert by_id(cache.evaluate_cached(pairs(spark), store, CONFIG)) == wanted
    assert 0 < before < store.size(CONFIG) == every
    # the last plan of each run is that of the new pairs
    assert (scored[1], scored[3]) == (before, every - before)
    assert by_id(cache.evaluate_cached(pairs(spark), store, CONFIG)) == wanted
    assert scored[5] == 0
    monkeypatch.undo()
    # another setting has results of its own
    other = EvalConfig(toxicity=False, alignment=False, custom_rules=True)
    rule = [Rule("a", "A", "mail", "keyword")]
    assert cache.setting_key(other, rule) != cache.setting_key(other, [])
    assert by_id(cache.evaluate_cached(pairs(spark), store, other, rule)) == by_id(
        batch.dedup_evaluate(pairs(spark), other, rule))
    assert store.size(CONFIG) == len({v[0] for v in wanted.values()})


def test_stored_results_are_not_shuffled(spark):
    store = cache.ResultCache(spark, scratch_path(spark, "store"), 4)
    out = cache.evaluate_cached(pairs(spark), store, CONFIG)
    found = cache.stored_result(pairs(spark), store, "hello", "hello", CONFIG)
    assert found.count() == 1 and found.head().passed
    assert cache.stored_result(pairs(spark), store, "hello", "nothing like it", CONFIG).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pair_digest," in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out.select("id", "passed")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the run's own rows
    assert "Bucketed: true" in plan


@pytest.mark.parametrize("start", [0, -5])
def test_waves_stop_after_a_failure(spark, monkeypatch, start):
    """A batch of 4,000 rows that fails at its second, one that fails late, one that never fails, small ones."""
    rows = [("early", start + n, n == 1) for n in range(4000)] + [("late", n * 2, n == 700) for n in range(900)]
    rows += [("fine", n, False) for n in range(50)] + [("one", 7, True), (None, 1, True), (None, 2, False)]
    df = spark.createDataFrame(rows, "batch string, pos int, bad boolean").select(
        "batch", "pos", F.concat_ws("-", F.coalesce("batch", F.lit("?")), "pos").alias("id"),
        F.when(F.col("bad"), "mail a@b.co").otherwise("fine").alias("prompt"), F.lit("ok").alias("response"))
    sizes, real = [], batch.cut_lineage

    def counted(found):
        out = real(found)
        if "passed" in out.columns:
            sizes.append({r[0]: r[1] for r in out.groupBy("batch").count().collect()})
        return out

    monkeypatch.setattr(batch, "cut_lineage", counted)
    out = batch.evaluate_until_failure(df, "batch", "pos", CONFIG, first_wave=16)
    got = {b: n for b, n in out.groupBy("batch").count().collect()}
    assert got == {"early": 2, "late": 701, "fine": 50, "one": 1, None: 1}
    assert [s.get("early", 0) for s in sizes] == [16] + [0] * (len(sizes) - 1)
    assert sum(s.get("late", 0) for s in sizes) == 900 and len(sizes) <= 5
    plain = batch.batch_fail_fast(evaluate(df, CONFIG), "batch", "pos")
    assert {r.id for r in plain.collect()} == {r.id for r in out.collect()}


def test_find_evaluation_reads_one_day(spark):
    path = scratch_path(spark, "log")
    rows = evaluate(pairs(spark), CONFIG).withColumn("timestamp", F.expr(
        "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(substring_index(id, '-', -1) as int))"))
    results.append_evaluations(rows.filter("id < '1'"), path)
    results.append_evaluations(rows.filter("id >= '1'"), path)
    some = rows.filter("id = '2-9'").head().evaluation_id
    found = results.find_evaluation(spark, path, some)
    assert [r.evaluation_id for r in found.collect()] == [some]
    metrics = found._jdf.queryExecution().executedPlan()
    assert results.find_evaluation(spark, path, "eval_none").count() == 0
    assert "array_contains" in metrics.toString() and "PartitionFilters" in metrics.toString()
    results.expire_days(spark, path, datetime(2024, 1, 12), 2)
    ids = spark.read.parquet(results.ids_path(path))
    assert ids.agg(F.min("dt")).head()[0].isoformat() == "2024-01-10"
