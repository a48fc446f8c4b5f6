"""All checks against their DuckDB twins at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
NAMES = list(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as db:
        for file in TABLES.glob("*.parquet"):
            db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        yield db


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows), sorted(columns)


@pytest.mark.filterwarnings("ignore:rule broken")
@pytest.mark.parametrize("name", NAMES)
def test_check_agrees_with_sql(spark, duck, name):
    found = entry.queries()[name](spark, str(TABLES))
    wanted = duck.sql(entry.oracle_sql()[name])
    assert table(found.columns, found.collect()) == table(wanted.columns, wanted.fetchall())


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.filterwarnings("ignore:rule broken")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_exported_counters_cover_the_whole_log():
    for name in ("metrics_summary", "prometheus_rows"):
        assert "LIMIT" not in entry.oracle_sql()[name]


def test_texts_are_dealt_out_without_a_sort(spark):
    """A file that one task reads is dealt out by key; dealing in turn would have it sorted by that task."""
    from checks import base

    made = spark.range(100).selectExpr("id AS doc_id", "'t' AS text")
    plan = base.dealt(made)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and "hashpartitioning" in plan
    assert base.dealt(made).distinct().count() == 100
