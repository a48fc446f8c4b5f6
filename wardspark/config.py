"""What to score and when to flag."""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values: evaluator names in the order they run, and their score keys ---

SCORE_KEYS = {
    "toxicity": "toxicity",
    "alignment": "alignment",
    "hallucination": "hallucination_risk",
    "pii": "pii_risk",
    "prompt_injection": "prompt_injection_risk",
    "custom_rules": "custom_rules",
}


@dataclass(frozen=True)
class EvalConfig:
    """Toggles and thresholds of one evaluation."""

    toxicity: bool = True
    alignment: bool = True
    hallucination: bool = True
    pii: bool = False
    prompt_injection: bool = False
    custom_rules: bool = False
    toxicity_threshold: float = 0.7
    alignment_threshold: float = 0.5
    hallucination_threshold: float = 0.6
    pii_threshold: float = 0.1
    prompt_injection_threshold: float = 0.5
    custom_rules_threshold: float = 0.5
    fail_fast: bool = False
    details: bool = False
    pii_categories: tuple[str, ...] | None = None

    @classmethod
    def everything(cls, **changes) -> "EvalConfig":
        return cls(**{name: True for name in SCORE_KEYS} | changes)

    def only(self, names: list[str]) -> "EvalConfig":
        """This configuration with exactly the named evaluators."""
        unknown = sorted(set(names) - set(SCORE_KEYS))
        if unknown:
            raise ValueError(f"unknown evaluators: {unknown}; known: {list(SCORE_KEYS)}")
        return replace(self, **{name: name in names for name in SCORE_KEYS})

    @property
    def enabled(self) -> list[str]:
        return [name for name in SCORE_KEYS if getattr(self, name)]

    def threshold(self, name: str) -> float:
        return getattr(self, f"{name}_threshold")
