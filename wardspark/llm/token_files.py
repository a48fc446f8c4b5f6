"""Token ids in ORC files.

Documents are dealt out by ranges of their id and sorted, so the files, in the order of their
names, hold all documents in ascending order. Ids are an INT array, which ORC stores run-length
and delta encoded by stripe; ``doc_id`` has row indexes and Bloom filters, so a lookup reads only
the stripes and row groups that may hold it, and stripes are read in parallel.

A row has ``doc_id, part, offset, n_tokens, ids``: ``offset`` counts the ids of its own file before
it, so a document's place in the whole is found by adding the totals of the files before.

Ids are those of the library's plain call, so an added token that a text spells out (``<|endoftext|>``) has
its own id.

Null ids come first, equal ids are ordered by a hash of their text, and spread over files by it. A null text is
empty; the end id stands alone then. A text of any length is one row. An empty table gives files without rows.
Columns beside ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm.columns import ColumnCoder, merged, slices
from wardspark.llm.common import small, written

OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FIELDS = "part int, offset bigint, n_tokens bigint, ids array<int>"

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder(ColumnCoder):
    """A tokenizer file as the library's plain call applies it.

    New words are encoded many at once, one behind the other: the pre-tokenizer cuts before each,
    so no token spans two, and their ends are found again by the number of bytes of each token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        # a task has one core; threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = [token["content"] for token in json.load(file)["added_tokens"]]
        # no added token: a pattern that nothing matches
        self.added = "|".join(map(re.escape, added)) or r"[^\x00-\x{10FFFF}]"
        # a byte-level vocabulary writes each byte as one character
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, "<i4") for found in (
            self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def new(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, and where in them each part's begin, and how many these are."""
        alone = np.array([not k or k[0] == " " or k[-1].isspace() for k in keys], bool)
        sizes, ids = np.zeros(len(keys), np.int64), [np.zeros(0, "<i4")]
        places = np.flatnonzero(~alone)
        for at in range(0, len(places), 20_000):
            chunk = [keys[n] for n in places[at:at + 20_000].tolist()]
            lines = [" " + " ".join(chunk[i:i + 200]) for i in range(0, len(chunk), 200)]
            ids.append(np.concatenate(self._library(lines)))
            widths = pc.binary_length(pa.array(chunk, pa.string())).to_numpy() + 1
            ends = np.searchsorted(np.cumsum(self.sizes[ids[-1]]), np.cumsum(widths)) + 1
            sizes[places[at:at + 20_000]] = np.diff(ends, prepend=0)
        single = np.flatnonzero(alone)
        found = self._library([keys[n][1:] if keys[n][:1] == " " else " " + keys[n]
                               for n in single.tolist()])
        sizes[single] = [len(x) for x in found]
        order = np.concatenate((places, single))
        begins = np.zeros(len(keys), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids + found), begins, sizes

    def encode_column(self, texts: pa.StringArray) -> pa.ListArray:
        """A list of ids for each text; one that spells out an added token goes to the library whole."""
        special = pc.match_substring_regex(texts, self.added)
        plain = texts.filter(pc.invert(special))
        out = super().encode_column(plain)
        if len(plain) == len(texts):
            return out
        return merged(special, pa.array(self._library(texts.filter(special).to_pylist()),
                                        pa.list_(pa.int32())), out)


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, offset = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                found = encoder.encode_column(rows.column("text").fill_null(""))
                ends = found.offsets.to_numpy()[1:].astype(np.int64)
                flat = np.insert(found.flatten().to_numpy(), ends, end_id)
                bounds_ids = np.append(0, ends + np.arange(1, len(ends) + 1))
                sizes = np.diff(bounds_ids)
                ids = pa.ListArray.from_arrays(pa.array(bounds_ids, pa.int32()),
                                               pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)),
                     pa.array(offset + bounds_ids[:-1], pa.int64()), pa.array(sizes), ids],
                    ["doc_id", "part", "offset", "n_tokens", "ids"])
                offset += int(bounds_ids[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the ids of each ``text`` of ``docs`` (``doc_id, text``), an end id after each, as a
    folder of ORC files. ``tokenizer`` is a file that every executor has."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}"
    ordered = (docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    writer = ordered.mapInArrow(_encode(tokenizer, end_id), schema).write
    writer.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``, ``start`` being the ids of all documents before."""
    rows = spark.read.orc(path)
    totals = written(rows.groupBy("part").agg(F.sum("n_tokens").alias("own")), "totals")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    starts = totals.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    return rows.join(small(starts), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; other stripes are skipped by their statistics and filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy().astype("<u4", copy=False)
            bounds = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"),
                 pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = tokens.select("doc_id", "start").schema.add("n_tokens", "long")
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, schema.add("ids_crc32", "long"))
