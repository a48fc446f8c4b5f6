"""Compacted change logs against replays of all changes, with changes that come late or twice."""

import random
from datetime import datetime, timedelta

import pytest

from wardspark.operators import compaction, keyed
from wardspark.session import scratch_path

START = datetime(2024, 3, 1)
RULES = ("rule_id string, op string, name string, description string, rule_type string, pattern string, "
         "severity double, action string, apply_to string, priority int, enabled boolean, changed_at timestamp, seq long")
CONFIGS = ("name string, op string, config_data string, description string, activate boolean, changed_at timestamp, "
           "seq long")


def history(kind, seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        key, at = rng.choice(["a", "b", "c", None] if kind == "rules" else ["a", "b", "c"]), START + timedelta(
            minutes=rng.choice([i, i, i - 9]))
        if kind == "rules":
            op = rng.choice(["save", "save", "toggle", "toggle", "delete"])
            rows.append((key, op, f"n{i}", None, "regex", f"p{i}", i / 100, "flag", "both", i % 4, rng.random() < 0.5,
                         at, i))
        else:
            op = rng.choice(["save", "save", "save", "activate", "delete"])
            rows.append((key, op, f"c{i}", None, rng.choice([True, False, None]), at, i))
    return rows


@pytest.mark.parametrize("kind,seed,n", [("rules", 1, 12), ("rules", 2, 40), ("rules", 3, 90), ("rules", 4, 25),
                                         ("configs", 1, 12), ("configs", 2, 40), ("configs", 3, 90), ("configs", 4, 25)])
def test_snapshot_and_later_changes_equal_the_replay(spark, kind, seed, n):
    schema, compact, current = {
        "rules": (RULES, compaction.compact_rules, keyed.rules_current),
        "configs": (CONFIGS, compaction.compact_configs, keyed.configs_current)}[kind]
    rows, rng, path = history(kind, seed, n), random.Random(seed), scratch_path(spark, "changes")
    runs = [[] for _ in range(4)]
    for row in rows:
        runs[rng.randrange(4)].append(row)  # in no order of time
    runs[3] += rng.sample(rows, n // 3)     # repeated
    for number, run in enumerate(runs):
        compaction.append_changes(spark.createDataFrame(run, schema), path, number)
        if number in (1, 2):
            compaction.write_snapshot(spark, path, compact, number)

    def view(df):
        return sorted(map(repr, current(df).collect()))

    wanted = view(spark.createDataFrame(rows, schema))
    found = compaction.read_changes(spark, path)
    assert view(found) == wanted
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"run=3", "upto=2"}
    snapshot = spark.read.parquet(f"{path}-snapshots/upto=2")
    assert snapshot.count() < sum(map(len, runs[:3])) or n < 20
    assert view(compact(compact(spark.createDataFrame(rows, schema)))) == wanted


def test_no_changes(spark):
    for schema, compact in ((RULES, compaction.compact_rules), (CONFIGS, compaction.compact_configs)):
        assert compact(spark.createDataFrame([], schema)).count() == 0
