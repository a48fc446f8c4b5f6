"""Files in and out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardspark.plans.evaluate import evaluate
from wardspark.session import scratch_path
from wardspark.sources import pairs, results, rules


def test_csv_pairs(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('prompt,response,extra\nQ1,A1,x\n"Q,2 ""quoted""","A\n2",y\n')
    rows = pairs.read_pairs_csv(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, "Q1", "A1"), (1, 'Q,2 "quoted"', "A\n2")]
    with pytest.raises(ValueError, match="nothing"):
        pairs.read_pairs_csv(spark, str(path), prompt_col="nothing")


def test_row_numbers_across_files(spark):
    path = scratch_path(spark, "csv")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").select(
        F.col("id").cast("string").alias("prompt"), F.lit("r").alias("response")).write.csv(
        path, header=True)
    rows = pairs.read_pairs_csv(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1000))


def test_row_numbers_follow_paths_and_lines(spark, tmp_path):
    sizes = {"a.csv": 3, "b.csv": 50, "c.csv": 10, "d.csv": 0}
    wanted = []
    for name, rows in sizes.items():
        lines = [f"{name}-{i}" for i in range(rows)]
        (tmp_path / name).write_text("prompt,response\n" + "".join(f"{x},r\n" for x in lines))
        wanted += lines
    for multi_line in (True, False):
        rows = pairs.read_pairs_csv(spark, str(tmp_path), multi_line=multi_line).orderBy("id").collect()
        assert [r.prompt for r in rows] == wanted and [r.id for r in rows] == list(range(63))


def test_json_pairs_get_the_same_id_every_time(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text('{"prompt": "p", "response": "r"}\n{"id": "x", "prompt": "p", "response": "r", '
                    '"metadata": {"k": "v"}}\n')
    first, second = (sorted(r.id for r in pairs.read_pairs_json(spark, str(path)).collect())
                     for _ in range(2))
    assert first == second and first[1] == "x" and first[0].startswith("item_")


def test_made_ids_tell_equal_and_null_texts_apart(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text('{"prompt": "p", "response": "r"}\n' * 3 + '{"prompt": "p|||r"}\n'
                    '{"prompt": "p|||r", "response": ""}\n')
    ids = [r.id for r in pairs.read_pairs_json(spark, str(path)).collect()]
    assert len(set(ids)) == 5 and all(len(i) == 29 for i in ids)


def test_conversations(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
        (2, 0, "user", "q3"), (2, 1, "user", "q4"), (2, 2, "assistant", "a4"),
        (3, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = {(r.id, r.prompt, r.response) for r in pairs.pairs_from_conversations(turns).collect()}
    assert got == {("1-1", "q1", "a1"), ("2-1", "q4", "a4")}


def test_conversations_with_gaps(spark):
    rng = random.Random(4)
    numbers = sorted({rng.randrange(-9, 9) * 65536 ** rng.randrange(4) + rng.randrange(3)
                      for _ in range(150)})
    rows = [(c, n, rng.choice(["user", "assistant"]), f"{c} {n}") for c in (1, 2) for n in numbers]
    wanted = {(a[3], b[3]) for a, b in zip(rows, rows[1:])
              if a[0] == b[0] and (a[2], b[2]) == ("user", "assistant")}
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows + [(None, 1, "user", "x"), (1, None, "assistant", "y")],
                                  "conv_id long, turn long, role string, text string")
    got = [(r.prompt, r.response) for r in pairs.pairs_from_conversations(turns).collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_result_files(spark, tmp_path):
    data = spark.createDataFrame([("1", " p ", "a@b.co"), ("2", "p", "fine")],
                                 "id string, prompt string, response string")
    out = evaluate(data).withColumn("timestamp", F.lit("2024-01-01 01:02:03").cast("timestamp"))
    path = scratch_path(spark, "json")
    results.write_results_json(out, path)
    doc = json.loads(spark.read.text(path).orderBy("value").head()[0])
    assert doc["timestamp"] == "2024-01-01T01:02:03.000000" and not doc["passed"]
    back = results.read_results_json(spark, path)
    assert back.count() == 2 and back.filter("timestamp is null").count() == 0
    table = scratch_path(spark, "csv")
    results.write_results_csv(out, table)
    assert spark.read.csv(table, header=True).columns[:4] == ["id", "passed", "flags_count", "flags"]


def test_result_defaults(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"evaluation_id": "e"}\n')
    r = results.read_results_json(spark, str(path)).head()
    assert (r.scores, r.flags, r.passed, r.timestamp) == ({}, [], True, None)


def test_rules_are_appended_once(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"id": "a", "name": "A", "type": "keyword", "pattern": "x"}\n'
                    '{"rule_id": "s", "name": "S", "rule_type": "script", "pattern": "x"}\n')
    known = rules.read_rules(spark, str(path))
    assert [tuple(r) for r in known.collect()] == [
        ("a", "A", "x", "keyword", 0.5, "flag", "both", True),
        ("s", "S", "x", "script", 0.5, "flag", "both", True)]
    known = known.filter("rule_id = 'a'")
    new = known.withColumn("pattern", F.lit("y")).unionByName(
        known.withColumn("rule_id", F.lit("b"))).unionByName(known.withColumn("rule_id", F.lit("b")))
    got = {r.rule_id: r.pattern for r in rules.append_rules(known, new).collect()}
    assert got == {"a": "x", "b": "x"}


def test_log_source_is_checked(spark):
    with pytest.raises(ValueError):
        results.log_rows(spark.range(1), "elsewhere")


def test_scratch_tables_are_gone_after_their_block(spark):
    from pathlib import Path

    from wardspark.session import scratch_path, scratch_tables

    outside = scratch_path(spark, "stays")
    spark.range(3).write.parquet(outside)
    with scratch_tables(spark):
        inside = scratch_path(spark, "goes")
        spark.range(3).write.parquet(inside)
        assert spark.read.parquet(inside).count() == 3
    assert not Path(inside).exists() and spark.read.parquet(outside).count() == 3
