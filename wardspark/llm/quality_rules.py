"""Quality rules as a ledger: measurements and one failure bit per rule.

Every rule is evaluated once. Policies are versioned masks over the bits, applied and compared
without another look at the texts. All of it is column functions; no row moves.

A null or empty text has no words, so all measurements are 0 and only ``few_words`` fails.
Ties, repeated rows and extra columns don't matter: each row is judged by its own text, however long (a text has
fewer than 2 ** 31 words). An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import spaced_words, whole_row

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper"]

# Rule number is the bit; a rule fails where its condition over the measurements is true.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "upper_case": "100 * n_upper > 50 * word_chars",
}
BASE = ["few_words", "repeated_words"]
POLICIES = {1: BASE, 2: list(RULES)}


def mask(names: list[str]) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def _window_keys(words: Column) -> Column:
    """A long for each 3-word window: bits of its hash above its number. Sorted, equal windows are
    neighbours, and so are a few others that share those bits."""
    n = F.size(words)
    return F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda word, i: F.shiftleft(
            F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("long")))


_PLACE = (1 << 31) - 1


def _bits(key: Column) -> Column:
    return F.shiftright(key, 31)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(_PLACE)).cast("int")


def _suspects(keys: Column) -> Column:
    """Of the sorted window keys those that share their bits with a neighbour."""
    return F.filter(keys, lambda key, i: F.coalesce(
        (_bits(key) == _bits(F.get(keys, i + 1))) | (_bits(key) == _bits(F.get(keys, i - 1))), F.lit(False)))


def _follower(values: Column) -> Column:
    return F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))


def _covered(places: Column) -> Column:
    """Words covered by windows at these places, sorted."""
    steps = F.zip_with(places, _follower(places),
                       lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeat_words(words: Column, suspects: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows that share their bits are nearly always equal. Neighbours are compared word by word, and if any
    two differ, all suspects are sorted by their words.
    """
    def word(key: Column, more: int) -> Column:
        return F.get(words, _place(key) + more)

    unlike = F.exists(F.zip_with(suspects, _follower(suspects), lambda x, y: (_bits(x) == _bits(y)) & ~(
        (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)))), lambda x: x)
    windows = F.sort_array(F.transform(suspects, lambda key: F.struct(
        _bits(key).alias("bits"), *[word(key, n).alias(c) for n, c in enumerate("abc")], _place(key).alias("at"))))
    twins = F.zip_with(windows, _follower(windows), lambda x, y: F.when(
        (x["bits"] == y["bits"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]),
        F.array(x["at"], y["at"])))
    equal = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    return F.when(F.coalesce(unlike, F.lit(False)), _covered(equal)).otherwise(
        _covered(F.sort_array(F.transform(suspects, _place))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (the whole input row) and the measurements, all LONG."""
    base = docs.select(whole_row(docs).alias("_row"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    base = base.withColumn("words", spaced_words(F.col("t")))
    base = base.withColumn("lines", F.filter(F.split("t", "\n"),
                                             lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    keyed = base.select("*", F.sort_array(_window_keys(F.col("words"))).alias("keys"))
    keyed = keyed.select("*", _suspects(F.col("keys")).alias("suspects"))
    found = [
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("suspects")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("n_upper")]
    found = keyed.select("_row", *found)
    return found.select("_row", *[F.col(m).cast("long") for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row``, the measurements and ``failed`` BIGINT with one bit per failed rule."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0))
            for bit, rule in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", total.cast("long"))


def passes(names: list[str], failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(names))) == 0


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """Ledger rows with ``kept`` by the policy of that version."""
    return entries.withColumn("kept", passes(POLICIES[version]))


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """``rule, failing, only_this``: documents that fail a rule of the policy, and those that
    would be kept without that rule. Counted once per combination of bits (128 at most)."""
    whole = mask(POLICIES[version])
    combos = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).alias("bit"))
                                for n in POLICIES[version]])).alias("r")
    seen = combos.select("bits", "count", rules).select("bits", "count", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def total(condition):
        return F.sum(F.when(condition, F.col("count")).otherwise(0))

    return seen.groupBy("rule").agg(total(hit).alias("failing"),
                                    total(F.col("bits") == F.col("bit")).alias("only_this"))
