"""A stored cache of results: pairs that an earlier run has scored are never scored again.

Results lie in a Parquet table, bucketed by the digest of the pair and with Bloom filters on it, one table per setting
(configuration and rules). A run looks up the digests of its pairs, scores one copy of each new pair, appends
these results and gives every row the stored one. The join with the stored results doesn't move them,
however many there are: only the run's own rows are shuffled, into the buckets.

A pair has one result, so the model outputs of its first copy count (see ``plans.batch``). Two runs at the same time may
both store a pair; equal pairs are told apart by nothing but the moment, and the table is read through
``stored``, which keeps one. An interrupted append leaves no rows, as Spark commits whole jobs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspark.config import EvalConfig
from wardspark.functions import hashing
from wardspark.operators.rules import rules_from_rows
from wardspark.plans.batch import KEYS, evaluated_copies, keyed
from wardspark.plans.evaluate import PairColumns

BUCKETS = 64
PAIR = "pair_digest"


def setting_key(config: EvalConfig, rule_list=()) -> str:
    """What results depend on besides the pair, as 24 hex digits."""
    rules = [repr(r) for r in rules_from_rows(rule_list)] if config.custom_rules else []
    return hashlib.sha256("\n".join([repr(config), *rules]).encode()).hexdigest()[:24]


@dataclass(frozen=True)
class ResultCache:
    """Tables of results below ``path``. A table keeps the number of buckets that it was made with."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _table(self, setting: str, schema: StructType) -> str:
        where = f"{self.path}/setting={setting}"
        name = "results_" + hashlib.sha256(where.encode()).hexdigest()[:24]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                       f"OPTIONS ('parquet.bloom.filter.enabled#{PAIR}' 'true') "
                       f"CLUSTERED BY ({PAIR}) SORTED BY ({PAIR}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def stored(self, setting: str, schema: StructType) -> DataFrame:
        """One result per pair of a setting, by the digest of the pair; the grouping needs no shuffle."""
        rows = self.spark.table(self._table(setting, schema))
        return rows.groupBy(PAIR).agg(*[F.first(f.name).alias(f.name) for f in schema if f.name != PAIR])

    def size(self, config: EvalConfig = EvalConfig(), rule_list=()) -> int:
        """How many results a setting has stored."""
        where = f"{self.path}/setting={setting_key(config, rule_list)}"
        return self.spark.read.parquet(where).select(PAIR).distinct().count()

    def append(self, setting: str, results: DataFrame) -> None:
        """Stores results; each bucket is written by one task."""
        name = self._table(setting, results.schema)
        results.repartition(self.buckets, PAIR).write.insertInto(name)

    def lookup(self, setting: str, schema: StructType, prompt: str, response: str) -> DataFrame:
        """The stored result of one pair: of each file, sorted by digest, the row groups are read whose range and Bloom
        filter may hold it."""
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (prompt, response)]
        wanted = hashlib.sha256("|".join(digests).encode()).hexdigest()
        return self.spark.table(self._table(setting, schema)).filter(F.col(PAIR) == wanted).limit(1)


def _paired(df: DataFrame, names: PairColumns) -> DataFrame:
    return keyed(df, names).withColumn(PAIR, F.sha2(F.concat_ws("|", *KEYS), 256))


def _results(rows: DataFrame, config: EvalConfig, rule_list, names: PairColumns) -> DataFrame:
    found = evaluated_copies(rows.drop(PAIR), config, rule_list, names)
    return found.select(F.sha2(F.concat_ws("|", *KEYS), 256).alias(PAIR),
                        *[c for c in found.columns if c not in KEYS])


def evaluate_cached(df: DataFrame, cache: ResultCache, config: EvalConfig = EvalConfig(), rule_list=(),
                    names: PairColumns = PairColumns()) -> DataFrame:
    """``dedup_evaluate`` that scores only pairs without a stored result, and stores theirs."""
    setting = setting_key(config, rule_list)
    rows = _paired(df, names)
    schema = _results(rows, config, rule_list, names).schema
    new = rows.join(cache.stored(setting, schema).select(PAIR), PAIR, "left_anti")
    cache.append(setting, _results(new, config, rule_list, names))
    found = cache.stored(setting, schema)
    return rows.join(found, PAIR).select(*df.columns, *[f.name for f in schema if f.name != PAIR])


def stored_result(df: DataFrame, cache: ResultCache, prompt: str, response: str,
                  config: EvalConfig = EvalConfig(), rule_list=(),
                  names: PairColumns = PairColumns()) -> DataFrame:
    """The stored result of one pair, if any; ``df`` only tells which columns pairs have."""
    schema = _results(_paired(df, names), config, rule_list, names).schema
    return cache.lookup(setting_key(config, rule_list), schema, prompt, response)
