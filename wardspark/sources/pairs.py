"""Prompt-response pairs from files and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark import schemas

# Turns that one window task may order: slim rows of a conversation's stretch of turn numbers.
_STRETCH_BITS = 16


def row_numbers(df: DataFrame, out: str = "id") -> DataFrame:
    """Adds the 0-based row number of a file source: by path, then by place in the file.

    A block of a file is read by one task in order, so its rows have successive ids there;
    the number of rows in the blocks before is added. That table has one row per block.
    """
    block = ["_path", "_start"]
    placed = df.select(*df.columns, F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_at"))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (placed.groupBy(*block).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
             .select(*block, "_first",
                     F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (placed.join(sizes, block)
            .select((F.col("_before") + F.col("_at") - F.col("_first")).alias(out),
                    *[c for c in df.columns if c != out]))


def read_pairs_csv(spark: SparkSession, path: str, prompt_col: str = "prompt",
                   response_col: str = "response", id_col: str | None = None,
                   multi_line: bool = True) -> DataFrame:
    """Pairs of a CSV file with a header; the row number is the id, unless a column is named.

    Values may span lines; ``multi_line=False`` lets Spark split large files where they
    do not.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"',
                         inferSchema=False)
    for column in (prompt_col, response_col, id_col):
        if column and column not in raw.columns:
            raise ValueError(f"column '{column}' not found in {path}")
    pairs = raw.select(F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"),
                       *([F.col(id_col).alias("id")] if id_col else []))
    return pairs.select("id", "prompt", "response") if id_col else row_numbers(pairs)


def read_pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON-lines file; a missing id is made from the texts and the row's number.

    The number tells rows with equal texts apart; a null text counts as another than an empty one.
    """
    raw = row_numbers(spark.read.schema(schemas.PAIR).json(path), "_row")
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
             for c in ("prompt", "response")]
    made = F.sha2(F.concat(F.col("_row").cast("string"), F.lit("|"), *parts), 256)
    return raw.withColumn("id", F.coalesce(
        "id", F.concat(F.lit("item_"), F.substring(made, 1, 24)))).drop("_row")


def _border_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, next``: the last turn of each stretch of turn numbers and the first one of the next
    stretch that holds any. Nothing for conversations within one stretch."""
    ends = (turns.select("conv_id", F.col("turn").cast("long").alias("turn"))
            .groupBy("conv_id", F.shiftright("turn", _STRETCH_BITS).alias("stretch"))
            .agg(F.min("turn").alias("first"), F.max("turn").alias("turn")))
    along = Window.partitionBy("conv_id").orderBy("stretch")
    return (ends.withColumn("next", F.lead("first").over(along)).filter("next IS NOT NULL")
            .select("conv_id", "turn", "next"))


def pairs_from_conversations(turns: DataFrame) -> DataFrame:
    """Each user turn with the next turn of its conversation, if that is the assistant's.

    The turn numbers of a conversation are distinct, but may have gaps. Turns are ordered within stretches of
    65,536 turn numbers, so a conversation of any length is spread over many tasks; only the pairs across two stretches
    need joins, which are empty for most tables.
    """
    placed = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    inside = Window.partitionBy("conv_id", F.shiftright(F.col("turn").cast("long"), _STRETCH_BITS)).orderBy("turn")
    after = F.lead(F.struct("role", "text")).over(inside)
    within = (placed.withColumn("_after", after).filter("role = 'user' AND _after.role = 'assistant'")
              .select("conv_id", "turn", F.col("text").alias("prompt"), F.col("_after.text").alias("response")))

    def side(role, number, name):
        return placed.filter(F.col("role") == role).select(
            "conv_id", F.col("turn").alias(number), F.col("text").alias(name))

    across = (_border_turns(placed).join(side("user", "turn", "prompt"), ["conv_id", "turn"])
              .join(side("assistant", "next", "response"), ["conv_id", "next"])
              .select("conv_id", F.col("turn").cast(turns.schema["turn"].dataType).alias("turn"), "prompt",
                      "response"))
    return within.unionByName(across).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "prompt", "response")
