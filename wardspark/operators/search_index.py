"""Substring search in a log by an index of trigrams.

The index lists, for every three ASCII characters in a row, the seconds of the evaluations whose lower-cased prompt or
response holds them. A search takes the trigrams of the literal stretches of its pattern, keeps the seconds
that all of them share, and matches only evaluations of these seconds, newest days first, until the page is full. A
pattern without a stretch of three ASCII characters is searched for in the whole log.

The log is indexed in blocks of rows, each within one task: a row of the index holds a trigram, a block, and where in the
block's list of seconds the trigram occurs. So nothing is shuffled, and a trigram costs a bit or two bytes per second of its
block, not a row. Files are sorted by trigram, so that a search reads only the pages of its own.

Whatever the index says, a row is matched with the pattern itself: an agreement by chance costs a match, and a row in the index that
is no longer in the log costs nothing. The index grows by appending, as the log does.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators.log import NEWEST_FIRST, page, search_evaluations
from wardspark.session import cut_lineage

# A block ends at so many rows or bytes of text; a longer text is a block by itself.
BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 22
# Ends each text: no trigram of ASCII characters reaches over it.
END = "\u0080"
# Days of the first wave; each later one takes three times as many.
FIRST_DAYS = 2
# The places of gram SECONDS are the block's seconds, in 8 bytes each; other places are numbers in that list, in 2 bytes each
# or, if that takes no more room, as a bitmap.
SCHEMA = "gram int, block string, places binary"
SECONDS = -1
BITMAP_BYTES = BLOCK_ROWS // 8


def text_grams(data: bytes) -> np.ndarray:
    """Distinct trigrams of ASCII characters, packed into integers."""
    units = np.frombuffer(data, np.uint8).astype(np.int32)
    if len(units) < 3:
        return np.zeros(0, np.int32)
    packed = (units[:-2] << 16) | (units[1:-1] << 8) | units[2:]
    plain = (units[:-2] | units[1:-1] | units[2:]) < 128
    return np.unique(packed[plain])


def pattern_grams(query: str) -> list[int]:
    """Trigrams that a text which matches the pattern holds; ``%`` and ``_`` are wildcards."""
    stretches = re.findall(r"[\x00-\x7f]+", re.sub("[%_]", "\u0080", query))
    return sorted({int(g) for s in stretches for g in text_grams(s.lower().encode())})


def _rows(block: str, grams: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of the index whose ``places`` take ``sizes`` bytes each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(ends), pa.py_buffer(places)])
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array([block]).take(pa.array(np.zeros(len(grams), np.int8))),
                                       cut], ["gram", "block", "places"])


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of the sorted values differ from the one before."""
    return np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])


def _block(data: np.ndarray, lengths: np.ndarray, seconds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the index for texts laid end to end, each closed by ``END``."""
    own, place = np.unique(seconds, return_inverse=True)
    key = data[:-2].astype(np.uint32)  # 7 bits a character, 11 of the place
    for part, bits in ((data[1:-1], 7), (data[2:], 7), (np.repeat(place.astype(np.uint32), lengths)[2:], 11)):
        key <<= bits
        key |= part
    key = np.sort(key[(data[:-2] | data[1:-1] | data[2:]) < 128])
    key = key[_firsts(key)]
    starts = np.flatnonzero(_firsts(key >> 11))
    counts = np.diff(np.append(starts, len(key)))
    gram = (key[starts] >> 11).astype(np.int32)
    gram = (gram >> 14) << 16 | (gram >> 7 & 127) << 8 | gram & 127
    places = (key & (BLOCK_ROWS - 1)).astype(np.uint16)
    many = 2 * counts >= BITMAP_BYTES
    within = np.repeat(many, counts)
    bits = np.zeros((int(many.sum()), BLOCK_ROWS), bool)
    bits[np.repeat(np.arange(len(bits)), counts[many]), places[within]] = True
    block = uuid.uuid4().hex  # rows of a block are written by one attempt of a task
    yield _rows(block, np.array([SECONDS]), np.array([8 * len(own)]), own.astype(np.int64))
    yield _rows(block, gram[~many], 2 * counts[~many], places[~within])
    yield _rows(block, gram[many], np.full(len(bits), BITMAP_BYTES), np.packbits(bits, axis=1))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index of ``second, text``, block by block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seconds, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:][:len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        first = 0
        while first < len(texts):
            fitting = int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, "right")) - 1
            last = min(max(fitting, first + 1), first + BLOCK_ROWS, len(texts))
            yield from _block(data[ends[first]:ends[last]], np.diff(ends[first:last + 1]), seconds[first:last])
            first = last


def append_index(log: DataFrame, path: str) -> None:
    """Adds new rows of a log (``timestamp, prompt, response``) to the index."""
    texts = [F.concat(F.coalesce(F.lower(c), F.lit("")), F.lit(END)) for c in ("prompt", "response")]
    second = F.floor(F.unix_micros("timestamp") / F.lit(1_000_000)).alias("second")
    dated = log.filter(F.col("timestamp").isNotNull()).select(second, F.concat(*texts).alias("text"))
    (dated.mapInArrow(_index, SCHEMA).sortWithinPartitions("gram")
     .write.mode("append").option("compression", "zstd").parquet(path))


def _places(packed: bytes) -> np.ndarray:
    if len(packed) == BITMAP_BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))
    return np.frombuffer(packed, np.uint16)


def _shared(seconds: Column, places: Column) -> Column:
    """A block's seconds that are in all lists of places."""
    @F.pandas_udf("array<bigint>")
    def run(seconds: pd.Series, places: pd.Series) -> pd.Series:
        found = []
        for own, lists in zip(seconds, places):
            held = np.zeros(len(own) // 8, np.int64)
            for packed in lists:
                held[_places(packed)] += 1
            found.append(np.frombuffer(own, np.int64)[held == len(lists)])
        return pd.Series(found, dtype=object)

    return run(seconds, places)


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``dt, second`` that may hold matches; None if the pattern has no trigram."""
    grams = pattern_grams(query)
    if not grams:
        return None
    hits = spark.read.schema(SCHEMA).parquet(path).filter(F.col("gram").isin([SECONDS, *grams]))
    listing = F.col("gram") == SECONDS
    blocks = (hits.groupBy("block").agg(F.first(F.when(listing, F.col("places")), ignorenulls=True).alias("seconds"),
                                        F.collect_list(F.when(~listing, F.col("places"))).alias("lists"))
              .filter(F.size("lists") == len(grams)))
    # a second may be in several blocks
    return (blocks.select(F.explode(_shared(F.col("seconds"), F.col("lists"))).alias("second")).distinct()
            .select(F.to_date(F.timestamp_seconds("second")).alias("dt"), "second"))


def search_indexed(log: DataFrame, path: str, query: str, limit: int = 50) -> DataFrame:
    """What ``search_evaluations`` finds, by way of the index at ``path``."""
    spark = log.sparkSession
    found = candidates(spark, path, query)
    if found is None:
        return search_evaluations(log, query, limit)
    found = cut_lineage(found)
    days = [r[0] for r in found.select("dt").distinct().orderBy(F.desc("dt")).collect()]  # one row a day
    dated = log if "dt" in log.columns else log.withColumn("dt", F.to_date("timestamp"))
    second = F.floor(F.unix_micros("timestamp") / F.lit(1_000_000))
    rows, size, taken, wave = None, 0, 0, FIRST_DAYS
    while taken < len(days) and size < limit:
        own = days[taken:taken + wave]
        taken, wave = taken + wave, 3 * wave
        at = found.filter(F.col("dt").isin(own)).select(F.col("dt").alias("_dt"), F.col("second").alias("_second"))
        kept = dated.filter(F.col("dt").isin(own)).join(at, (F.col("dt") == F.col("_dt")) & (second == F.col("_second")),
                                                        "left_semi")
        part = cut_lineage(search_evaluations(kept.select(*log.columns), query, limit))
        size += part.count()
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return log.filter("false")
    return page(rows, NEWEST_FIRST, limit)
