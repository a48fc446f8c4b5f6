"""Session settings, the shared folder and reliable lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Changeable at run time; they only affect how plans run, and UTC timestamps.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys of a join even where that costs another exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A one-process session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("wardspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        # plans have many expressions; recording the call site of each doubles their cost
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Where it is unset, a one-process session gets a temporary folder of its own; a
    cluster must name one.
    """
    context = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if named and not current:
        context.setCheckpointDir(named)
    if named or current:
        return named or current
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="wardspark-"))
    return context.getCheckpointDir()


_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    for paths in _OPEN:
        paths.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write to the shared folder inside the block, at its end.

    Results read them: store what is to stay before the block ends.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        jvm = spark.sparkContext._jvm
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def moment(value) -> Column:
    """A timestamp literal; a time without zone is one of the session's zone, whatever the zone
    of the driver."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp")


def compute_once(df: DataFrame, keep: list[str], computed: list[str]) -> DataFrame:
    """``keep`` and ``computed``, the latter behind a generator of one row.

    Without it a filter on a derived column is pushed down with the whole expression in it,
    and every match runs a second time.
    """
    one = F.array(F.struct(*[F.col(c) for c in computed]))
    return df.select(*[F.col(c) for c in keep], F.inline(one))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that every reader sees the same rows in
    the same partitions even after executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
