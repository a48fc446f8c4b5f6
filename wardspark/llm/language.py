"""Language identification in two steps: the family, then the language within it.

Each decision is taken by one-versus-one linear support vector machines over hashed byte n-grams
of the letters: first between families, then between the closely related languages of the winner.
A machine is trained by stochastic gradient descent on the hinge loss, on a bounded sample per
language. A text costs one count of its n-grams and one small matrix product.

A null text, or one without a letter, is ``und`` with score 0. Rows without a language aren't learned
from. With one learned language everything with a letter is that language. A family is a fixed
table; languages outside it are families of their own. Ties go to the first name. Repeated rows get equal
results; a very long text is counted in slices; identifying keeps whole rows, so no column can clash; an empty table
gives an empty result, and nothing learned leaves every text ``und``. A letter is a character of a letter category, so number signs are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import labelled_sample, whole_row
from wardspark.llm.features import byte_grams

BITS = 12
GRAMS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 400
EPOCHS = 8
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

# Language families.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY = {language: family for family, members in FAMILIES.items() for language in members}

# A-Z in lower case; other ASCII is a gap.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
                 for c in range(256))


def vector(text: object) -> np.ndarray:
    """Square roots of the n-gram counts, scaled to length 1."""
    total = np.zeros(1 << BITS, np.float32)
    data = text.encode().translate(_LETTERS) if isinstance(text, str) else b""
    if data:
        for part in byte_grams(data, GRAMS, BITS):
            total += np.bincount(part, minlength=1 << BITS)
    total = np.sqrt(total)
    return total / max(float(np.linalg.norm(total)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, decay: float = 1e-3,
            seed: int = 1) -> tuple[np.ndarray, float]:
    """Mean over the second half of the steps of the weights and bias of a linear machine; y is
    1 or -1. Classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, kept, step = np.zeros_like(w), 0.0, 0, 0
    weight = {s: len(y) / (2 * max(int((y == s).sum()), 1)) for s in (1, -1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            step += 1
            rate = 1 / (decay * (step + 100))
            wrong = y[i] * (x[i] @ w + b) < 1
            w *= 1 - rate * decay
            if wrong:
                w += rate * weight[int(y[i])] * y[i] * x[i]
                b += 0.01 * rate * y[i]
            if 2 * epoch >= epochs:
                mean_w, mean_b, kept = mean_w + w, mean_b + b, kept + 1
    return mean_w / max(kept, 1), mean_b / max(kept, 1)


@dataclass
class Group:
    """Names and a machine for each pair of them; positive means the first."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Group:
        group = cls(sorted(set(names.tolist())))
        pairs = list(combinations(group.names, 2))
        found = []
        for a, b in pairs:
            rows = (names == a) | (names == b)
            found.append(machine(x[rows], np.where(names[rows] == a, 1, -1)))
        if found:
            group.weights = np.stack([w for w, _ in found], axis=1)
            group.biases = np.array([b for _, b in found])
        return group

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of the winner and its confidence."""
        count = len(self.names)
        margins = x @ self.weights + self.biases
        own = np.full((len(x), count, count), np.inf)
        for k, (a, b) in enumerate(combinations(range(count), 2)):
            own[:, a, b], own[:, b, a] = margins[:, k], -margins[:, k]
        wins = (own > 0).sum(axis=2) * 1e6 + np.clip(
            np.where(np.isinf(own), 0, own), -1e3, 1e3).sum(axis=2)
        best = wins.argmax(axis=1)
        least = own[np.arange(len(x)), best].min(axis=1, initial=np.inf)
        return best, 1 / (1 + np.exp(-np.clip(2 * least, -30, 30)))


@dataclass
class Model:
    families: Group
    within: dict[str, Group]

    @classmethod
    def fit(cls, x: np.ndarray, languages: np.ndarray) -> Model:
        family = np.array([FAMILY.get(v, v) for v in languages], dtype=object)
        return cls(Group.fit(x, family), {
            f: Group.fit(x[family == f], languages[family == f]) for f in sorted(set(family))})

    def predict(self, texts: list[object]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if isinstance(t, str) and LETTER.search(t)]
        if not known or not self.families.names:
            return names, scores
        x = np.stack([vector(texts[i]) for i in known])
        family, sure = self.families.decide(x)
        for number, name in enumerate(self.families.names):
            rows = np.flatnonzero(family == number)
            if len(rows):
                group = self.within[name]
                best, closer = group.decide(x[rows])
                for row, b, c in zip(rows, best, closer):
                    names[known[row]] = group.names[b]
                    scores[known[row]] = sure[row] * c
        return names, scores


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits about ``per_language`` rows of each ``lang`` of ``docs`` (``doc_id, text, lang``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vector(t) for t in batch["text"]]
            at = [np.flatnonzero(x).astype(np.int16) for x in found]
            yield pd.DataFrame({"lang": batch["lang"], "key": batch["key"], "at": at,
                                "share": [x[i] for x, i in zip(found, at)]})

    sample = labelled_sample(docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull()), "lang", per_language, F.col("doc_id"))
    rows = (sample.select(F.xxhash64("doc_id", "text").alias("key"), "text", "lang")
            .filter(F.col("text").rlike(r"\p{L}"))
            .mapInPandas(run, "lang string, key long, at array<smallint>, share array<float>").toPandas()
            .sort_values(["lang", "key"]))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for own, at, share in zip(x, rows["at"], rows["share"]):
        own[np.asarray(at)] = share
    return Model.fit(x, rows["lang"].to_numpy(dtype=object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``_row`` (the whole row of ``docs``), ``lang_pred`` and ``score`` of its ``text``."""
    @F.pandas_udf("lang_pred string, score double")
    def found(texts):
        names, scores = [], []
        for at in range(0, len(texts), 500):
            n, s = model.predict(texts.iloc[at:at + 500].tolist())
            names += n
            scores += s.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select(whole_row(docs).alias("_row"), found("text").alias("found"))
    return rows.select("_row", "found.lang_pred", "found.score")
