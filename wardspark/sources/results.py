"""Results as CSV and JSON files, and the evaluation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark import schemas
from wardspark.config import SCORE_KEYS
from wardspark.functions import hashing

# Quotes doubled, white space at the ends of values kept.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}

LOG_SOURCES = ("api", "cli", "dashboard")


def results_table(results: DataFrame, row_id: str = "id") -> DataFrame:
    """Flat rows for a CSV file: flags joined, one column per score."""
    return results.select(
        row_id, "passed", F.size("flags").alias("flags_count"),
        F.array_join("flags", "; ").alias("flags"),
        *[F.col("scores")[key].alias(key) for key in SCORE_KEYS.values()])


def write_results_csv(results: DataFrame, path: str, row_id: str = "id") -> None:
    results_table(results, row_id).write.csv(path, mode="errorifexists", **CSV_OPTIONS)


def result_json(results: DataFrame) -> DataFrame:
    """``value``: one JSON document per result, absent parts written as empty ones."""
    full = [F.col("evaluation_id"),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            "scores", "flags", "passed", "metadata"]
    if "detailed_results" in results.columns:
        full.append("detailed_results")
    return results.select(F.to_json(F.struct(*full)).alias("value"))


def write_results_json(results: DataFrame, path: str) -> None:
    result_json(results).write.mode("errorifexists").text(path)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Results written by ``write_results_json``, or with parts missing: then scores and
    flags are empty and the verdict is passed."""
    raw = spark.read.schema(schemas.RESULT).json(path)
    return raw.select(
        "evaluation_id", F.to_timestamp("timestamp").alias("timestamp"),
        F.coalesce("scores", F.create_map().cast("map<string,double>")).alias("scores"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
        F.coalesce("passed", F.lit(True)).alias("passed"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        "detailed_results")


def _log_columns(results: DataFrame, source: str) -> list[Column]:
    """The columns of the evaluation log but for its day."""
    def optional(name, kind, default=None):
        return (F.col(name) if name in results.columns
                else F.lit(default).cast(kind).alias(name))

    def as_json(name):
        if name not in results.columns:
            return F.lit("{}").alias(name)
        return F.coalesce(F.to_json(name), F.lit("{}")).alias(name)

    return [*map(F.col, ("evaluation_id", "timestamp", "prompt", "response")),
            hashing.text_hash(F.col("prompt")).alias("prompt_hash"),
            hashing.text_hash(F.col("response")).alias("response_hash"),
            *map(F.col, ("passed", "scores", "flags")), as_json("metadata"), as_json("detailed_results"),
            optional("latency_ms", "double", 0.0), optional("source", "string", source),
            optional("user_id", "string"), optional("session_id", "string")]


def _check_source(source: str) -> None:
    if source not in LOG_SOURCES:
        raise ValueError(f"source must be one of {LOG_SOURCES}")


def log_rows(results: DataFrame, source: str = "api") -> DataFrame:
    """Rows of the evaluation log from results with a ``timestamp``."""
    _check_source(source)
    return results.select(*_log_columns(results, source), F.to_date("timestamp").alias("dt"))


# Rows that a task has of a day, on average, from which on they are written where they are.
ROWS_PER_FILE = 10_000
_NEEDED = ("evaluation_id", "timestamp", "prompt", "response", "passed", "scores", "flags", "metadata",
           "detailed_results", "latency_ms", "source", "user_id", "session_id")


def append_evaluations(results: DataFrame, path: str, source: str = "api") -> None:
    """Appends to the log, partitioned by day, and the days of the ids to a table beside it.

    A pass over the times tells how many rows of a day a task has. If these make files worth having, each task writes its
    own rows and no text is shuffled. Else rows are balanced by day with adaptive splitting, so that a busy day is written by
    many tasks and a quiet one by few; digests and JSON are made after that. Inside a file rows are sorted for row-group skipping.
    """
    _check_source(source)
    rows = (results.select(*[c for c in results.columns if c in _NEEDED])
            .withColumn("dt", F.to_date("timestamp")))
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(source))
    # ids first: one without a row is harmless, a row without its id would not be found
    (rows.select("evaluation_id", "dt", _drawer(F.col("evaluation_id")).alias("drawer"))
     .repartition("drawer").sortWithinPartitions("drawer", "evaluation_id")
     .write.mode("append").options(**_bloom("evaluation_id")).partitionBy("drawer").parquet(ids_path(path)))
    files = rows.groupBy(F.spark_partition_id().alias("task"), "dt").agg(F.count("*").alias("n"))
    total, count = files.agg(F.sum("n"), F.count("*")).head()
    balanced = rows if (total or 0) >= ROWS_PER_FILE * count else rows.hint("rebalance", "dt")
    ordered = balanced.sortWithinPartitions("dt", "source", "timestamp")
    (ordered.select(*_log_columns(ordered, source), "dt")
     .write.mode("append").options(compression="zstd", **_bloom("evaluation_id")).partitionBy("dt").parquet(path))


def _bloom(column: str) -> dict[str, str]:
    """A Bloom filter as large as the values ask for."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def ids_path(path: str) -> str:
    """Where the days of the ids of a log are."""
    return path.rstrip("/") + "-ids"


def _drawer(evaluation_id: Column) -> Column:
    """One of 16 parts of the table of ids: the last digit of the id."""
    return F.lower(F.right(evaluation_id, F.lit(1)))


def find_evaluation(spark: SparkSession, path: str, evaluation_id: str) -> DataFrame:
    """The rows of one id in the log at ``path``.

    The table of ids tells the days: of one of its 16 parts, sorted by id, the row groups are read whose range and Bloom
    filter may hold the id. Only these days of the log are read, and of them the row groups whose Bloom filter
    may hold it.
    """
    wanted = F.lit(evaluation_id)
    if not _exists(spark, ids_path(path)):  # a log written without ids
        return spark.read.parquet(path).filter(F.col("evaluation_id") == wanted)
    ids = spark.read.schema("evaluation_id string, dt date, drawer string").parquet(ids_path(path))
    days = (ids.filter((F.col("drawer") == evaluation_id[-1:].lower()) & (F.col("evaluation_id") == wanted))
            .agg(F.collect_set("dt")).scalar())
    return spark.read.parquet(path).filter(F.array_contains(days, F.col("dt"))
                                           & (F.col("evaluation_id") == wanted))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_periods(summaries: DataFrame, path: str) -> None:
    """Writes summary rows, replacing those of the same periods that were there before.

    Files are replaced by day; the other periods of a touched day are carried over, by way of the
    shared folder, since a day can't be read while it is replaced.
    """
    from wardspark.session import cut_lineage

    rows = summaries.withColumn("dt", F.to_date("period_start"))
    spark = summaries.sparkSession
    if _exists(spark, path):
        rows = cut_lineage(rows)
        days = rows.select("period_type", "dt").distinct()
        rest = (spark.read.schema(rows.schema).parquet(path)
                .join(days, ["period_type", "dt"], "left_semi")
                .join(rows.select("period_type", "period_start"), ["period_type", "period_start"],
                      "left_anti"))
        rows = cut_lineage(rows.unionByName(rest))
    (rows.hint("rebalance", "dt")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period_type", "dt").parquet(path))


def expire_days(spark: SparkSession, path: str, now, days: int) -> int:
    """Drops rows of a ``dt``-partitioned table older than ``days``; returns how many.

    Days wholly before the cutoff are dropped by deleting their folders; only the day the
    cutoff falls on is rewritten.
    """
    from wardspark.operators.log import retention
    from wardspark.session import cut_lineage, moment

    table = spark.read.parquet(path)
    kept, expired = retention(table, now, days)
    cutoff_day = F.to_date(moment(now) - F.expr(f"interval {int(days)} days"))
    gone = expired.filter(F.col("dt") <= cutoff_day)
    per_day = {r["dt"]: r["n"] for r in gone.groupBy("dt").agg(F.count("*").alias("n")).collect()}
    if not per_day:
        return 0
    boundary = spark.range(1).select(cutoff_day.alias("d")).head()["d"]
    if boundary in per_day:
        # the day to rewrite is copied to the shared folder before it is replaced
        rest = cut_lineage(kept.filter(F.col("dt") == F.lit(boundary)))
        if rest.isEmpty():
            _delete_day(spark, path, boundary)
        else:
            (rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("dt").parquet(path))
    for day in per_day:
        if day != boundary:
            _delete_day(spark, path, day)
    if _exists(spark, ids_path(path)):
        ids = spark.read.schema("evaluation_id string, dt date, drawer string").parquet(ids_path(path))
        cut_lineage(ids.filter(F.col("dt") >= cutoff_day)).write.mode("overwrite").options(
            **_bloom("evaluation_id")).partitionBy("drawer").parquet(ids_path(path))
    return sum(per_day.values())


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _delete_day(spark: SparkSession, path: str, day) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
