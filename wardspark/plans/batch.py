"""Evaluations of whole batches: deduplicated, summarised, cut at or stopped after the first failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from wardspark.config import SCORE_KEYS, EvalConfig
from wardspark.functions import hashing
from wardspark.functions import text as T
from wardspark.operators.metrics import file_summary
from wardspark.plans.evaluate import PairColumns, evaluate, exceeds, flag_text
from wardspark.session import cut_lineage
from wardspark.sources.pairs import read_pairs_csv
from wardspark.sources.results import write_results_csv


def evaluate_batch(df: DataFrame, position: str, config: EvalConfig = EvalConfig(),
                   rule_list=(), names: PairColumns = PairColumns()) -> DataFrame:
    """One result per pair; ``position`` keeps the order of the input."""
    if position not in df.columns:
        raise ValueError(f"no column {position}")
    return evaluate(df, config, rule_list, names)


def evaluate_file(spark: SparkSession, path: str, output: str,
                  config: EvalConfig = EvalConfig(), rule_list=(), **columns) -> DataFrame:
    """Evaluates the pairs of a CSV file into CSV files; returns the summary.

    Results are cut from their lineage, so that files and summary come from one evaluation.
    """
    pairs = read_pairs_csv(spark, path, **columns)
    results = evaluate(pairs, config, rule_list).drop("prompt", "response")
    results = cut_lineage(results)
    write_results_csv(results, output)
    return file_summary(results)


KEYS = ["prompt_hash", "response_hash"]


def keyed(df: DataFrame, names: PairColumns = PairColumns()) -> DataFrame:
    """``df`` with the digests of both texts; a null text has an empty one, so its rows meet, too."""
    return df.withColumns({key: F.coalesce(hashing.text_hash(F.col(text)), F.lit(""))
                           for key, text in zip(KEYS, (names.prompt, names.response))})


def _sortable(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return F.array_sort(F.map_entries(column)) if isinstance(df.schema[name].dataType, MapType) else column


def first_copies(rows: DataFrame, names: PairColumns = PairColumns()) -> DataFrame:
    """Of the ``keyed`` rows of each pair those with the least id and, among these, the least model outputs: one, or
    several that are equal in all that a result depends on.

    Only digests, ids and model outputs are aggregated, combined per task; the texts are looked up by a join, whose hot
    keys the adaptive skew join splits.
    """
    outputs = [c for c in (names.toxicity, names.toxicity_error, names.prompt_vector, names.response_vector,
                           names.alignment_error) if c in rows.columns]
    order = F.struct(F.col(names.id), *[_sortable(rows, c).alias(f"o{n}") for n, c in enumerate(outputs)])
    least = rows.groupBy(*KEYS).agg(F.min(order).alias("_least"))
    return rows.join(least, KEYS).filter(order.eqNullSafe(F.col("_least"))).drop("_least")


def evaluated_copies(rows: DataFrame, config: EvalConfig, rule_list, names: PairColumns) -> DataFrame:
    """The digests and the result of each pair of the ``keyed`` rows; the shared id comes from the pair alone."""
    found = evaluate(first_copies(rows, names).withColumn(names.id, F.lit("")), config, rule_list, names)
    return found.select(*KEYS, *[c for c in found.columns if c not in rows.columns]).dropDuplicates(KEYS)


def dedup_evaluate(df: DataFrame, config: EvalConfig = EvalConfig(), rule_list=(),
                   names: PairColumns = PairColumns()) -> DataFrame:
    """Evaluates each distinct pair once and gives its copies the same result; all columns stay.

    Copies are found by the two text digests, never by the joined text; the first copy's model outputs
    count, whatever the order of the rows. A hot pair is split by the adaptive skew join.
    """
    rows = keyed(df, names)
    results = evaluated_copies(rows, config, rule_list, names)
    return rows.join(results, KEYS).drop(*KEYS)


def batch_fail_fast(df: DataFrame, batch: str, position: str) -> DataFrame:
    """Per batch the rows up to and including the first one that did not pass; a null batch is one, too.

    The first failures are pre-aggregated per task; no batch is ever gathered or sorted. Both sides read ``df``: store
    results that are dear, or evaluate them by ``evaluate_until_failure``.
    """
    first = (df.filter(~F.col("passed")).groupBy(F.col(batch).alias("_batch"))
             .agg(F.min(position).alias("_first")))
    return (df.join(first, df[batch].eqNullSafe(first["_batch"]), "left").drop("_batch")
            .filter(F.col("_first").isNull() | (F.col(position) <= F.col("_first")))
            .drop("_first"))


FIRST_WAVE = 64


def evaluate_until_failure(df: DataFrame, batch: str, position: str, config: EvalConfig = EvalConfig(),
                           rule_list=(), names: PairColumns = PairColumns(),
                           first_wave: int = FIRST_WAVE) -> DataFrame:
    """``batch_fail_fast`` that stops evaluating a batch soon after its first failure.

    Waves of positions, each four times as long as all before, are evaluated and written one after the other; a batch that has
    failed leaves the next wave. So no row is evaluated twice, a batch that fails at its n-th row has at most about
    5 n rows evaluated, and there are few waves however long a batch is. Positions count from any number
    and may have gaps; a null position is evaluated in the first wave.
    """
    start = F.coalesce(F.col(position).cast("long") - F.col("_start"), F.lit(0))
    starts = df.groupBy(F.col(batch).alias("_batch")).agg(F.min(F.col(position).cast("long")).alias("_start"),
                                                          F.max(F.col(position).cast("long")).alias("_end"))
    starts = cut_lineage(starts)
    longest = starts.agg(F.max(F.col("_end") - F.col("_start"))).head()[0] or 0
    placed = df.join(starts, df[batch].eqNullSafe(starts["_batch"])).withColumn("_at", start).drop(
        "_batch", "_start", "_end")
    waves, failed, low, high = [], None, 0, first_wave
    while low <= longest:
        rows = placed.filter((F.col("_at") >= low) & (F.col("_at") < high))
        if failed is not None:
            rows = rows.join(failed, rows[batch].eqNullSafe(failed["_batch"]), "left_anti")
        wave = cut_lineage(evaluate(rows.drop("_at"), config, rule_list, names))
        waves.append(wave)
        own = wave.filter(~F.col("passed")).select(F.col(batch).alias("_batch")).distinct()
        failed = own if failed is None else failed.unionByName(own)
        low, high = high, 5 * high
    if not waves:
        return evaluate(df.filter("false"), config, rule_list, names)
    return batch_fail_fast(reduce(DataFrame.unionByName, waves), batch, position)


def batch_summary(df: DataFrame, batch: str, error: str | None = None, also=()) -> DataFrame:
    """Totals per batch; a row with an error counts as error only. ``also`` are columns that a
    batch has one value of."""
    bad = F.col(error).isNotNull() if error else F.lit(False)
    return df.groupBy(batch, *also).agg(
        F.count("*").alias("total"),
        F.count_if(~bad & F.col("passed")).alias("passed_count"),
        F.count_if(~bad & ~F.col("passed")).alias("failed_count"),
        F.count_if(bad).alias("error_count"))


def threshold_compare(scored: DataFrame, configs: dict[str, EvalConfig],
                      keep: list[str]) -> DataFrame:
    """Verdicts of one scored table under several threshold sets.

    Scores are read from the ``scores`` map, never recomputed; each row is multiplied by
    the number of threshold sets, after everything but ``keep`` and the map is gone.
    """
    sets = F.array(*[F.struct(
        F.lit(label).alias("config"),
        *[F.lit(c.threshold(n) if getattr(c, n) else None).cast("double").alias(n)
          for n in SCORE_KEYS]) for label, c in configs.items()])
    in_prompt = F.col("metadata.pii_location") == "prompt"
    rows = scored.select(*keep, "scores", in_prompt.alias("_in_prompt"),
                         F.explode(sets).alias("_set"))
    flags = []
    for name, key in SCORE_KEYS.items():
        value, limit = F.col("scores")[key], F.col("_set")[name]
        text = flag_text(name, value, F.coalesce("_in_prompt", F.lit(False)))
        flags.append(F.when(exceeds(name, value, limit), text))
    return (rows.withColumn("flags", T.keep_present(*flags))
            .select(*keep, F.col("_set")["config"].alias("config"), "flags",
                    (F.size("flags") == 0).alias("passed")))
