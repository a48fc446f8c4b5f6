"""Searches by the index of trigrams against scans."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardspark.operators import log as L
from wardspark.operators import search_index
from wardspark.session import scratch_path

WORDS = ["lamp", "ferry", "Rope", "gÜll", "the pier", "100%", "a_b", "back\\slash", "TIDE", "日本", "İzmir", "K-2"]


@pytest.fixture(scope="module")
def logged(spark):
    rng = random.Random(6)
    rows = [(f"e{n:04}", datetime(2024, 5, 1) + timedelta(seconds=rng.randrange(6 * 86400) if n % 3 else 77),
             " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5))) if n % 11 else None,
             " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4))) if n % 13 else "") for n in range(500)]
    log = spark.createDataFrame(rows, "evaluation_id string, timestamp timestamp, prompt string, response string")
    path = scratch_path(spark, "grams")
    search_index.append_index(log.filter("evaluation_id < 'e0300'"), path)
    search_index.append_index(log.filter("evaluation_id >= 'e0250'"), path)  # some rows twice
    return log, path


@pytest.mark.parametrize("limit", [3, 50, 1000])
@pytest.mark.parametrize("query", ["lamp", "LAMP ferry", "r_pe", "fer%tide", "the pier", "gÜll", "100%", "a_b", "back\\slash",
                                   "k-2", "zzz", "la", "", "日本", "İzmir", "zmir", "%", "pier lamp rope"])
def test_equals_the_scan(logged, query, limit):
    log, path = logged
    wanted = [r.evaluation_id for r in L.search_evaluations(log, query, limit).collect()]
    found = [r.evaluation_id for r in search_index.search_indexed(log, path, query, limit).collect()]
    assert sorted(found) == sorted(wanted)


def test_short_patterns_have_no_grams():
    for query in ("", "ab", "a%b_cd", "日本語", "é", "ab%cd"):
        assert search_index.pattern_grams(query) == []
    assert len(search_index.pattern_grams("abcabc")) == 3


def test_only_seconds_of_all_grams_are_read(spark, logged):
    log, path = logged
    found = search_index.candidates(spark, path, "lamp ferry")
    holding = log.filter(F.lower("prompt").contains("lamp ferry") | F.lower("response").contains("lamp ferry"))
    seconds = F.unix_micros("timestamp") / 1_000_000
    assert holding.select(seconds).distinct().count() <= found.count() < 250
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(gram" in plan


def test_index_is_a_row_per_trigram_and_block(spark):
    """Not one per trigram and second: a log of n rows would give n times its texts' trigrams."""
    rows = spark.range(0, 5000, 1, 2).select(
        F.timestamp_seconds(F.col("id") * 7).alias("timestamp"), F.lit("the same pier").alias("prompt"),
        F.format_string("K%04d", "id").alias("response"))
    path = scratch_path(spark, "grams")
    search_index.append_index(rows, path)
    index = spark.read.parquet(path)
    blocks = index.select("block").distinct().count()
    assert index.filter(F.col("gram") == search_index.SECONDS).count() == blocks == 4
    pairs = 5000 * (len(search_index.text_grams(b"the same pier")) + 3)
    assert index.count() < pairs / 10
    assert search_index.candidates(spark, path, "same pier").count() == 5000
    assert [r.second for r in search_index.candidates(spark, path, "k0123").collect()] == [123 * 7]


def test_blocks_of_any_texts():
    """Long and short texts, more than a block holds, null bytes and other scripts, against a search of each text."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c\0é日") for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))) for _ in range(6000)]
    texts[1234] = "x" * (search_index.BLOCK_BYTES + 5) + "yz"
    seconds = np.array([rng.randrange(-4000, 4000) for _ in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(seconds), pa.array([t + search_index.END for t in texts])], ["second", "text"])
    found, blocks = {}, {}
    parts = list(search_index._index(iter([batch.slice(0, 0), batch.slice(0, 2500), batch.slice(2500)])))
    for part in parts:
        for row in part.to_pylist():
            if row["gram"] == search_index.SECONDS:
                blocks[row["block"]] = np.frombuffer(row["places"], np.int64)
    for part in parts:
        for row in part.to_pylist():
            if row["gram"] != search_index.SECONDS:
                own = blocks[row["block"]][search_index._places(row["places"])]
                found.setdefault(row["gram"], set()).update(own.tolist())
    wanted = {}
    for second, text in zip(seconds.tolist(), texts):
        for stretch in re.findall(r"[\x00-\x7f]{3,}", text):
            for gram in search_index.text_grams(stretch.encode()).tolist():
                wanted.setdefault(gram, set()).add(second)
    assert found == wanted
    assert len(blocks) > 4
