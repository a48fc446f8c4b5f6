"""Ordinals, running totals and exact quantiles that never gather a group in one task.

Rows are cut into slices by splitters: of all rows the few with the smallest hash of their keys are an even
sample, and every n-th of these in order is a splitter. What slice a row is in depends on its keys and the
splitters alone, so the totals of the slices and the rows inside them are two plain parts of one lazy plan: nothing is
written, and every retry sees the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows sampled for each splitter; slices differ in size by about one part in the square root of it.
SAMPLED = 8


class Order:
    """Columns with a direction each; nulls are the smallest values, as in Spark's own order."""

    def __init__(self, columns: list[str], descending: list[bool] | None = None):
        self.columns = columns
        self.descending = descending or [False] * len(columns)

    def sort(self) -> list[Column]:
        return [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(self.columns, self.descending)]

    def keys(self) -> Column:
        """The columns as a struct ``k0, k1, ...``; with an array around each, which puts nulls first."""
        return F.struct(*[F.array(F.col(c)).alias(f"k{n}") for n, c in enumerate(self.columns)])

    def before(self, a: Column, b: Column) -> Column:
        """Whether the keys ``a`` come strictly before the keys ``b``."""
        out = F.lit(False)
        for n, down in reversed(list(enumerate(self.descending))):
            x, y = a[f"k{n}"], b[f"k{n}"]
            out = (x > y if down else x < y) | ((x == y) & out)
        return out


def _splitters(df: DataFrame, order: Order, slices: int) -> Column:
    """Scalar: sorted keys, at most ``slices - 1`` of them, that cut the rows into even parts."""
    sample = df.select(order.keys().alias("k")).orderBy(F.xxhash64("k")).limit(slices * SAMPLED)
    placed = F.array_sort(F.collect_list("k"), lambda a, b: F.when(order.before(a, b), -1).when(
        order.before(b, a), 1).otherwise(0))
    return sample.agg(F.filter(placed, lambda k, n: n % SAMPLED == SAMPLED - 1).alias("s")).scalar()


def _slice(key: Column, splitters: Column, order: Order, slices: int) -> Column:
    """The number of splitters before the key, by halving."""
    halves = F.array(*[F.lit(1 << n) for n in reversed(range(slices.bit_length()))])

    def step(at: Column, half: Column) -> Column:
        found = F.get(splitters, at + half - 1)  # null beyond the last one
        return at + F.when(found.isNotNull() & order.before(found, key), half).otherwise(0)

    return F.aggregate(halves, F.lit(0), step)


def running_total(df: DataFrame, by: list[str], order: list, out: str,
                  weight: Column | None = None, slices: int | None = None) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` (1 by default) over the rows of the same ``by``
    up to and including this one in ``order``.

    ``order`` lists columns, or (column, descending), which must not tie. The sum inside a slice is a window over that
    slice; what lies before it comes from the totals of the slices, of which a group has at most ``slices``.
    """
    weight = F.lit(1) if weight is None else weight
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = [(o, False) if isinstance(o, str) else o for o in order]
    inner = Order([c for c, _ in pairs], [d for _, d in pairs])
    full = Order([*by, *inner.columns], [False] * len(by) + inner.descending)
    placed = (df.withColumn("_splitters", _splitters(df, full, slices))
              .withColumn("_slice", _slice(full.keys(), F.col("_splitters"), full, slices)).drop("_splitters")
              .withColumn("_weight", weight))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (placed.groupBy(*by, "_slice").agg(F.sum("_weight").alias("_total"))
              .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
              .drop("_total"))
    totals = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_at"), "_before")
    inside = (Window.partitionBy(*by, "_slice").orderBy(*inner.sort())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.withColumn("_inside", F.sum("_weight").over(inside))
    same = F.col("_slice") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(totals, same).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def quantiles(df: DataFrame, by: str, value: str, points: dict[str, float],
              total: str = "total") -> DataFrame:
    """Exact interpolated quantiles of ``value`` per ``by``, one column per point, and the
    sum of the values.

    Equal values are counted before anything else, so a value shared by a third of the rows
    is one row. Ranks come from ``running_total`` over the distinct values.
    """
    counted = (df.filter(F.col(value).isNotNull()).groupBy(by, value)
               .agg(F.count("*").alias("_n")))
    ranked = running_total(counted, [by], [value], "_upto", F.col("_n"))
    sizes = ranked.groupBy(by).agg(F.max("_upto").alias("_size"),
                                   F.sum(F.col(value) * F.col("_n")).alias(total))
    placed = ranked.join(sizes, by)
    before = F.col("_upto") - F.col("_n")  # ranks before .. _upto - 1 hold this value
    at = {name: (F.col("_size") - 1) * F.lit(float(q)) for name, q in points.items()}
    picks = [F.max(F.when((rank(at[name]) >= before) & (rank(at[name]) < F.col("_upto")),
                          F.col(value))).alias(f"_{name}_{side}")
             for name in points for side, rank in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy(by).agg(F.first("_size").alias("_size"), F.first(total).alias(total),
                                   *picks)

    def between(name: str) -> Column:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return low + (high - low) * (at[name] - F.floor(at[name]))

    return found.select(by, total, *[between(name).alias(name) for name in points])


def nearest_ranks(df: DataFrame, by: str, value: str, points: dict[str, float],
                  times: Column | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per ``by`` without interpolation, one column per point: the
    smallest value that at least this share of the rows doesn't exceed. A row counts ``times``, or once."""
    counted = (df.filter(F.col(value).isNotNull()).groupBy(by, value)
               .agg((F.count("*") if times is None else F.sum(times)).alias("_n")))
    ranked = running_total(counted, [by], [value], "_upto", F.col("_n"))
    sizes = ranked.groupBy(F.col(by).alias("_by")).agg(F.max("_upto").alias("_size"))
    placed = ranked.join(sizes, ranked[by].eqNullSafe(sizes["_by"]))
    return placed.groupBy(by).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_size") * F.lit(q)), F.col(value))).alias(name)
        for name, q in points.items()])
