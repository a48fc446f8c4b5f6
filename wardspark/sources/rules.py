"""Rule tables as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark import schemas

RULE_COLUMNS = ["rule_id", "name", "pattern", "rule_type", "severity", "action", "apply_to",
                "enabled"]


def normalise(raw: DataFrame) -> DataFrame:
    """One spelling of the columns, defaults filled in. Rules of a type that can't be used, such as
    ``script``, stay listed, so that ``rule_problems`` can name them."""
    return raw.select(
        F.coalesce("rule_id", "id").alias("rule_id"), "name", "pattern",
        F.coalesce("rule_type", "type", F.lit("regex")).alias("rule_type"),
        F.coalesce("severity", F.lit(0.5)).alias("severity"),
        F.coalesce("action", F.lit("flag")).alias("action"),
        F.coalesce("apply_to", F.lit("both")).alias("apply_to"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.schema(schemas.RULE).json(path))


def write_rules(rules: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rules.select(*RULE_COLUMNS).write.mode(mode).json(path)


def append_rules(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known`` and those of ``new`` whose id is not taken; of equal new ids the first
    by content stays."""
    fresh = new.select(*RULE_COLUMNS).join(known.select("rule_id"), "rule_id", "left_anti")
    rest = [c for c in RULE_COLUMNS if c != "rule_id"]
    single = (fresh.groupBy("rule_id").agg(F.min(F.struct(*rest)).alias("_rule"))
              .select("rule_id", "_rule.*"))
    return known.select(*RULE_COLUMNS).unionByName(single)
