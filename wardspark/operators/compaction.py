"""Compaction of change logs: what a current view may still need, and nothing else.

A compacted log is a change log, too. With any later changes added to it, early or late or repeated, it gives the current
view that the full log with these changes gives:

- Changes of a key up to its last deletion never count again, since the last deletion only moves on. The deletion itself
  is kept.
- Of the saves after it the last one's payload counts. Of the others only the moments do, as a deletion that comes late may
  drop the first of them; their payload is left out.
- The last toggle after the deletion counts; the others don't, whatever comes.
- Of the changes that activate a configuration the last one anywhere counts.

Everything is a maximum per key, combined per task; no key's history is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators.keyed import RULE_FIELDS

_ORDER = ["changed_at", "seq"]


def _blank(changes: DataFrame, names: list[str], keep: Column) -> list[Column]:
    return [F.when(keep, F.col(n)).alias(n) if n in names else F.col(n) for n in changes.columns]


def compact_rules(changes: DataFrame) -> DataFrame:
    """The rule changes that still count, one row each."""
    order = F.struct(*_ORDER)
    save, delete, toggle = (F.col("op") == op for op in ("save", "delete", "toggle"))
    last = changes.groupBy(F.col("rule_id").alias("_id")).agg(
        *[F.max(F.when(c, order)).alias(n) for n, c in (("_save", save), ("_drop", delete), ("_toggle", toggle))])
    live = (changes.distinct().join(last, changes["rule_id"].eqNullSafe(F.col("_id")))
            .filter(F.col("_drop").isNull() | (order >= F.col("_drop")))
            .filter(save | delete | (toggle & (order == F.col("_toggle")))))
    return live.select(*_blank(changes, RULE_FIELDS, save & (order == F.col("_save"))))


def compact_configs(changes: DataFrame) -> DataFrame:
    """The configuration changes that still count, one row each."""
    order = F.struct(*_ORDER)
    save, delete = F.col("op") == "save", F.col("op") == "delete"
    turns_on = (F.col("op") == "activate") | (save & F.col("activate"))
    last = changes.groupBy(F.col("name").alias("_id")).agg(F.max(F.when(save, order)).alias("_save"),
                                                           F.max(F.when(delete, order)).alias("_drop"))
    switch = changes.agg(F.max(F.when(turns_on, order))).scalar()
    rows = changes.distinct().join(last, changes["name"].eqNullSafe(F.col("_id"))).withColumn("_switch", switch)
    on = F.coalesce(order == F.col("_switch"), F.lit(False)) & turns_on
    live = rows.filter(on | ((save | delete) & (F.col("_drop").isNull() | (order >= F.col("_drop")))))
    kept = _blank(changes, ["config_data", "description"], save & (order == F.col("_save")))
    return live.select(*[F.when(on, F.col("activate")).otherwise(F.lit(False)).alias("activate")
                         if n == "activate" else c for n, c in zip(changes.columns, kept)])


def append_changes(changes: DataFrame, path: str, run: int) -> None:
    """Adds changes as those of a run; runs are numbered upwards."""
    changes.write.parquet(f"{path}/run={run}")


def write_snapshot(spark: SparkSession, path: str, compact, run: int) -> None:
    """Stores the compacted changes of all runs up to ``run``, from the last snapshot and the runs after it."""
    compact(read_changes(spark, path, run)).write.parquet(f"{path}-snapshots/upto={run}")


def read_changes(spark: SparkSession, path: str, run: int | None = None) -> DataFrame:
    """The last snapshot and the runs after it, up to ``run`` if given; older runs are not read."""
    runs = _numbers(spark, path, "run")
    if run is not None:
        runs = [n for n in runs if n <= run]
    marks = [n for n in _numbers(spark, f"{path}-snapshots", "upto") if not runs or n <= runs[-1]]
    parts = [f"{path}/run={n}" for n in runs if not marks or n > marks[-1]]
    parts += [f"{path}-snapshots/upto={marks[-1]}"] if marks else []
    return spark.read.option("recursiveFileLookup", "true").parquet(*parts)


def _numbers(spark: SparkSession, path: str, label: str) -> list[int]:
    """Numbers of the complete folders ``label=n``, upwards."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [entry.getPath() for entry in system.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{label}=")
                  and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
