"""Evaluators by name: column functions from a text to a score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators import hallucination, injection, pii


@dataclass(frozen=True)
class Evaluator:
    """A text evaluator; ``score`` and ``detail`` map a text column to a column."""

    name: str
    description: str
    score: Callable[[Column], Column]
    detail: Callable[[Column], Column] | None = None


class EvaluatorRegistry:
    def __init__(self):
        self._known: dict[str, Evaluator] = {}

    def register(self, evaluator: Evaluator) -> None:
        if not callable(evaluator.score):
            raise TypeError("an evaluator needs a score function")
        self._known[evaluator.name] = evaluator

    def get(self, name: str) -> Evaluator:
        if name not in self._known:
            raise ValueError(f"unknown evaluator: {name}; known: {self.names()}")
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)

    def describe(self) -> dict[str, str]:
        return {name: e.description for name, e in self._known.items()}


def default_registry() -> EvaluatorRegistry:
    registry = EvaluatorRegistry()
    registry.register(Evaluator("hallucination", "Hedged, overconfident or unsupported claims",
                                hallucination.score, hallucination.detail))
    registry.register(Evaluator("pii", "Personal data", pii.score, pii.detail))
    registry.register(Evaluator("prompt_injection", "Prompt injection and jailbreak attempts",
                                injection.score, injection.detail))
    return registry


def risk_band(value: Column) -> Column:
    return F.when(value < 0.3, "Low Risk").when(value < 0.6, "Medium Risk").otherwise("High Risk")


def check_text(df: DataFrame, text: str, name: str, registry: EvaluatorRegistry | None = None,
               detailed: bool = False) -> DataFrame:
    """One evaluator over a text column: score, band and, if asked for, detail."""
    evaluator = (registry or default_registry()).get(name)
    out = df.withColumn("score", evaluator.score(F.col(text)))
    out = out.withColumn("risk_band", risk_band(F.col("score")))
    if detailed and evaluator.detail:
        out = out.withColumn("detail", evaluator.detail(F.col(text)))
    return out
