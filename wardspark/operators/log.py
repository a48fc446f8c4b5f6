"""Queries over the evaluation log and other append-only tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.functions import text as T
from wardspark.operators.ranking import running_total
from wardspark.session import moment

# Pages that end beyond this row are cut out by rank instead of by a top-n in one task.
TOP_ROWS = 10_000
NEWEST_FIRST = [("timestamp", True), "evaluation_id"]


def _between(df: DataFrame, timestamp: str, start, end) -> DataFrame:
    """Rows of [start, end]; a ``dt`` partition column is bounded as well, so that whole
    partitions are skipped."""
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        column, day = F.col(timestamp), moment(bound)
        df = df.filter(column >= day if after else column <= day)
        if "dt" in df.columns:
            limit = moment(bound).cast("date")
            df = df.filter(F.col("dt") >= limit if after else F.col("dt") <= limit)
    return df


def filtered(df: DataFrame, timestamp: str = "timestamp", start=None, end=None,
             **equal) -> DataFrame:
    """Rows in the time range whose columns equal the given values; ``None`` and empty
    text mean no filter."""
    df = _between(df, timestamp, start, end)
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == F.lit(value))
    return df


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``: columns, or (column, descending), which must not tie.

    A page near the front is a top-n. A far one would pull all rows before it into one
    task, so its rows are found by their distributed rank. Both are lazy and give the same rows.
    """
    if offset + limit <= TOP_ROWS:
        named = [(o, False) if isinstance(o, str) else o for o in order]
        top = df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in named])
        return (top.offset(offset) if offset else top).limit(limit)
    ranked = running_total(df, [], order, "_rank")
    return ranked.filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)
                         ).drop("_rank")


def list_evaluations(log: DataFrame, limit: int = 100, offset: int = 0,
                     passed: bool | None = None, source: str | None = None,
                     user_id: str | None = None, start=None, end=None,
                     order_by: str = "timestamp", descending: bool = True):
    """A page of the log and the total of the filtered rows, as two DataFrames."""
    kept = filtered(log, start=start, end=end, passed=passed, source=source, user_id=user_id)
    order = [(order_by if order_by in log.columns else "timestamp", descending), "evaluation_id"]
    return page(kept, order, limit, offset), kept.agg(F.count("*").alias("total"))


def get_evaluation(log: DataFrame, evaluation_id: str) -> DataFrame:
    """Of any table; ``sources.results.find_evaluation`` finds it in a stored log without reading the others' days."""
    return log.filter(F.col("evaluation_id") == evaluation_id)


def search_evaluations(log: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Newest evaluations whose prompt or response holds ``query``, ignoring case; ``%``
    and ``_`` in it are wildcards, a backslash is itself."""
    like = "%" + query.replace("\\", "\\\\") + "%"
    hit = F.col("prompt").ilike(like) | F.col("response").ilike(like)
    return page(log.filter(hit), NEWEST_FIRST, limit)


def timeline(log: DataFrame, by: str) -> DataFrame:
    """Ordinal of each evaluation among those of the same ``by``, and its result label."""
    slim = log.select(by, "timestamp", "evaluation_id", "passed")
    ranked = running_total(slim, [by], ["timestamp", "evaluation_id"], "ordinal")
    return ranked.withColumn("result", F.when(F.col("passed"), "Passed").otherwise("Failed"))


def trend(log: DataFrame) -> DataFrame:
    """Long table of scores over time."""
    return log.select("timestamp", "evaluation_id", F.explode("scores").alias("metric", "value"))


def history_view(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, with preview texts."""
    newest = page(log, NEWEST_FIRST, limit, offset)
    return newest.select("evaluation_id", "timestamp", T.preview(F.col("prompt")).alias("prompt"),
                         T.preview(F.col("response")).alias("response"), "passed", "scores",
                         "flags")


def retention(df: DataFrame, now: datetime, days: int, timestamp: str = "timestamp"):
    """Rows kept and rows expired, as two DataFrames."""
    cutoff = moment(now - timedelta(days=days))
    expired = F.col(timestamp) < cutoff
    return df.filter(~F.coalesce(expired, F.lit(False))), df.filter(expired)


def audit_list(audit: DataFrame, limit: int = 100, offset: int = 0, event_type: str | None = None,
               user_id: str | None = None, resource_type: str | None = None,
               start=None, end=None, tie: str = "resource_id"):
    """A page of the audit log, newest first, and the total of the filtered rows."""
    kept = filtered(audit, start=start, end=end, event_type=event_type, user_id=user_id,
                    resource_type=resource_type)
    return (page(kept, [("timestamp", True), tie], limit, offset),
            kept.agg(F.count("*").alias("total")))


def audit_append(rows: DataFrame, path: str) -> None:
    """Appends audit events, partitioned by day; a busy day is written by many tasks."""
    (rows.withColumn("dt", F.to_date("timestamp")).hint("rebalance", "dt")
     .write.mode("append").partitionBy("dt").parquet(path))
