"""Helpers that the operators share: words, row keys, folds, written tables, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# More rows than this are joined by shuffle, never broadcast.
BROADCAST_ROWS = 200_000
# A table of few short rows gets so many files at most, or as many as there are cores if that is more.
FEW_FILES = 48


def spaced_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def written(df: DataFrame, label: str, parts: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later steps don't repeat the work before, also when executors are lost. The
    table stays there as long as the folder.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df`` in partitions enough for all cores, without one more shuffle; for tables of short rows.

    Where a shuffle leaves many small partitions, each would be a file, and for each file a local
    store without Hadoop's native library starts a process that shares the executor's memory.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(FEW_FILES, cores))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Counts the rows, so ``df`` should be a written table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no derived name can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


KEY = ["k1", "k2"]


def row_key(key: Column, text: Column) -> list[Column]:
    """``k1, k2``: 128 bits of hash by which a row is found again. Never null; rows share them
    only if both id and text are the same."""
    parts = [key.isNull(), key, text.isNull(), text]
    return [F.xxhash64(F.lit(n), *parts).alias(name) for n, name in enumerate(KEY)]


def labelled_sample(df: DataFrame, label: str, per_label: int, key: Column) -> DataFrame:
    """About ``per_label`` rows of each label, the same in each run: those whose hashed key is
    small. All rows of a label with fewer. One counting pass fixes the limits."""
    counts = df.groupBy(label).count().collect()
    share = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    keep = F.lit(False)
    for row in counts:
        if row[0] is not None:
            keep = F.when(F.col(label) == F.lit(row[0]),
                          share < F.lit(min(1.0, per_label / row["count"]))).otherwise(keep)
    return df.filter(keep)
