"""SimHash near duplicates by covering locality-sensitive hashing.

Each of the 64 bits carries a code word, a non-zero vector of ``radius + 1`` bits. For each non-zero
vector v there is a table, keyed by the fingerprint under the mask of the bits whose code word has
an odd inner product with v. Any ``radius`` code words leave some v orthogonal to all of them, so two
fingerprints that differ in at most ``radius`` bits agree under that mask: every such pair meets
in some table, 15 tables for 3 bits. No chance is involved.

Texts with one fingerprint collapse before the tables. A table bucket is read as a stream and
yields a spanning forest of its links, never its pairs. A bucket above ``bucket_rows`` is dealt
out again by the bits its mask leaves free: these are cut into groups, and for each choice of
``radius`` groups a sub-bucket agrees on all other free bits. Such a sub-bucket has a bounded
number of members (2 to the power of the bits left out), and again every link is in one.

Links are followed to components by joins and grouped minima until nothing changes.

A null or empty text has the fingerprint zero, linked like any other. Repeated rows and rows with
a null id take part; the component id is the smallest id that isn't null, or null if
there is none. Texts of any length count whole; other columns may have any names and types; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from wardspark.llm.common import KEY, few, row_key, whole_row, written

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# Members that one task compares directly (a second or two); larger buckets are dealt out again.
BUCKET_ROWS = 20_000


def fingerprint(text: object, shingle: int = SHINGLE) -> int:
    """Bit majority of the XXH64 of all word shingles, repeats included."""
    words = (text if isinstance(text, str) else "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``k1, k2, doc_id, fp``: the fingerprint of each row as a signed BIGINT."""
    @F.pandas_udf("long")
    def fp(texts):
        return pd.Series([_signed(fingerprint(x, shingle)) for x in texts], dtype="int64")

    return docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id",
                       fp(F.col("text")).alias("fp"))


def masks(radius: int = RADIUS) -> list[int]:
    """One mask per non-zero vector of ``radius + 1`` bits."""
    size = 1 << (radius + 1)
    words = [1 + bit % (size - 1) for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (words[bit] & v).bit_count() % 2)
            for v in range(1, size)]


def sub_masks(mask: int, radius: int, groups: int) -> list[int]:
    """The mask widened by all but ``radius`` groups of its free bits, for each choice of these."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    cut = [sum(1 << b for b in free[i::groups]) for i in range(groups)]
    return [(1 << BITS) - 1 & ~sum(cut[i] for i in left)
            for left in itertools.combinations(range(groups), radius)]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the distinct ``values`` (signed) linked at ``radius`` bits or
    fewer."""
    signed, values = values, values.view(np.uint64)
    left = np.arange(len(values))
    edges = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):  # grow one tree, each value reached once
            rest, grown = values[left], []
            taken = np.zeros(len(left), bool)
            for node in front:
                near = np.bitwise_count(rest ^ values[node]) <= radius
                near &= ~taken
                if near.any():
                    edges += [(int(signed[node]), int(v)) for v in signed[left[near]]]
                    grown.append(left[near])
                    taken |= near
            front = np.concatenate(grown) if grown else left[:0]
            left = left[~taken]
    return edges


def _bucket_edges(radius: int, bucket_rows: int):
    """Streams rows ordered by (table, key): edges of full buckets, and members of those that
    are too large, with ``big`` set to their table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, current, too_large = 0, None, False
        out: list[tuple[int, int, int]] = []

        def close():
            nonlocal held, size
            if not too_large and size > 1:
                values = np.unique(np.concatenate(held))
                out.extend((a, b, -1) for a, b in forest(values, radius))
            held, size = [], 0

        def flush():
            rows, out[:] = list(out), []
            cols = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int32())], ["a", "b", "big"])

        for batch in batches:
            table = batch.column("tab").to_numpy()
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            if not len(fp):
                continue
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(table) != 0)) + 1
            bounds = [0, *edge.tolist(), len(fp)]
            for a, b in zip(bounds, bounds[1:]):
                at = (int(table[a]), int(key[a]))
                if at != current:
                    close()
                    current, too_large = at, False
                held.append(fp[a:b])
                size += b - a
                if size > bucket_rows:
                    too_large = True
                    for part in held:
                        out.extend((int(v), int(v), at[0]) for v in part)
                    held = []
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()
    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: edges that connect all distinct fingerprints (``fp``) linked at ``radius`` bits
    or fewer, at most a spanning forest per bucket."""
    def bucketed(rows, tables):
        listed = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(
            F.lit(_signed(m))).alias("key")) for i, m in enumerate(tables)])
        rows = rows.select("fp", F.explode(listed).alias("t")).select("fp", "t.tab", "t.key")
        return rows.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")

    schema = "a long, b long, big int"
    tables = masks(radius)
    first = written(bucketed(distinct, tables).mapInArrow(
        _bucket_edges(radius, bucket_rows), schema), "buckets")
    edges = first.filter("big < 0").select("a", "b")
    for table in [r.big for r in first.filter("big >= 0").select("big").distinct().collect()]:
        # at most 15 of these; sub-buckets hold 2**9 members or fewer at radius 3
        members = first.filter(F.col("big") == table).select(F.col("a").alias("fp"))
        finer = bucketed(members, sub_masks(tables[table], radius, max(10, radius + 1)))
        edges = edges.union(finer.mapInArrow(_bucket_edges(radius, BITS << 20), schema)
                            .select("a", "b"))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each node of the edges with the smallest node of its component.

    A round hooks every node to the smallest root around it, then each root to the root of its
    own root. Written after each round; the number of rounds grows with the logarithm of the
    longest path for the star-like links made here.
    """
    both = written(few(edges.union(edges.select(F.col("b"), F.col("a"))).distinct()), "edges")
    state = written(few(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("root"))), "roots")
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "root"), "b")
        around = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = state.join(around, "node").select(
            "node", "root", F.least("root", "near").alias("low"))
        # the root of a node hears of the smallest root that any of its nodes met
        heard = met.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("heard"))
        own = met.join(heard, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("low", F.coalesce("heard", "low"))
            .alias("up"))
        over = own.select(F.col("node").alias("up"), F.col("up").alias("top"))
        state = written(few(own.join(over, "up").select(
            "node", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("moved"))),
            "roots")
        if not state.filter("moved").limit(1).count():
            return state.select("node", "root")
        state = state.select("node", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``k1, k2, doc_id, fp, component_id, root`` for each row of ``docs`` (``doc_id, text``, ...);
    ``root`` tells components apart, also those without an id."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, bucket_rows))
    rooted = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(by_fp, "fp").select(*KEY, "doc_id", "fp", "component_id", "root")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, all columns of ``docs``: that with the smallest id (a null id
    last), then by hash of its text, then by its other columns, as far as these have an order (maps don't)."""
    found = near_duplicates(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *KEY)).alias("first")
    chosen = found.groupBy("root").agg(first).select("first.k1", "first.k2")
    rows = docs.select(whole_row(docs).alias("_row"), *row_key(docs["doc_id"], docs["text"]))
    # equal ids and texts: the other columns decide, as far as they have an order
    others = [F.col(f"_row.`{f.name}`") for f in docs.schema
              if f.name not in ("doc_id", "text") and _ordered(f.dataType)]
    one = F.min_by("_row", F.struct(F.lit(0), *others)).alias("_row")
    return rows.join(chosen, KEY).groupBy(*KEY).agg(one).select("_row.*")


def _ordered(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))
