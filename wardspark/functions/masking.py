"""Masked forms of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_pii(value: Column, category: str) -> Column:
    """``value`` with only the characters that its ``category`` may show."""
    tail = F.right(value, F.lit(4))
    generic = F.when(
        F.length(value) > 4,
        F.concat(F.substring(value, 1, 2), F.lit("***"), F.right(value, F.lit(2))),
    ).otherwise(F.lit("***"))
    if category == "email":
        at = F.instr(value, "@")
        single = F.regexp_count(value, F.lit("@")) == 1
        shown = F.concat(F.left(F.substring_index(value, "@", 1), F.lit(2)), F.lit("***"),
                         F.substring(value, at, F.length(value)))
        masked = F.when(single, shown).otherwise(generic)
    elif category in ("ssn", "credit_card"):
        masked = F.concat(F.lit("***"), tail)
    elif category == "phone_us":
        masked = F.concat(F.lit("***-***-"), tail)
    else:
        masked = generic
    return F.when(F.length(value) == 0, F.lit("")).otherwise(masked)
