"""Language identification as inference in a mixture of languages.

Each language is a smoothed distribution over hashed three-letter runs. The text of a document is a mixture of
these with unknown proportions: expectation-maximisation estimates them, and the set of languages is the one with
the highest likelihood less a penalty for every further language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import bounded_sample, long_rows, sent

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.5
STEPS = 10
#: Penalty for one more language, in units of the logarithm of the number of runs.
PENALTY = 8.0
TRAIN_DOCS = 2000

RESULT = "lang_pred string, score double, proportions map<string,double>"


class Letters:
    """For every code point its lower-case letter, or 0; made once per worker."""

    _table = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            table = np.zeros(0x110000, np.uint32)
            for point in range(0x110000):
                char = chr(point)
                if char.isalpha():
                    lower = char.lower()
                    table[point] = ord(lower) if len(lower) == 1 else point
            cls._table = table
        return cls._table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the runs of three letters; runs of other characters act as one space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = Letters.table()[points]
    solid = letters > 0
    if not solid.any():
        return np.empty(0, np.int64), np.empty(0)
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # the first character after a word stands for the gap
    body = np.concatenate(([0], letters[keep], [0])).astype(np.uint64)
    code = (body[:-2] * np.uint64(0x1F123BB5) + body[1:-1]) * np.uint64(0x2545F491) + body[2:]
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    counts = np.bincount(code.astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


@dataclass
class LanguageModel:
    """``likelihood[bucket, k]``: chance of the bucket in language ``languages[k]``."""

    languages: list[str]
    likelihood: np.ndarray

    def proportions(self, text: str | None) -> dict[str, float]:
        """Shares of the languages found, {} for null, for a text without letters or for an empty model."""
        if not text or not self.languages:
            return {}
        buckets, counts = gram_counts(text)
        if not len(buckets):
            return {}
        chances = self.likelihood[buckets]
        order = np.argsort(-(counts @ np.log(chances)), kind="stable")
        total, best = counts.sum(), None
        for size in range(1, len(order) + 1):
            chosen = chances[:, order[:size]]
            shares = np.full(size, 1.0 / size)
            for _ in range(STEPS if size > 1 else 0):
                shares = shares * (chosen.T @ (counts / (chosen @ shares))) / total
            value = counts @ np.log(chosen @ shares) - PENALTY * (size - 1) * np.log(total + 1)
            if best is not None and value <= best[0]:
                break
            best = (value, dict(zip((self.languages[k] for k in order[:size]), shares / shares.sum())))
        return {name: float(share) for name, share in best[1].items()}


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> LanguageModel:
    """Fits the model on about ``most`` documents of each language; rows without text or language are not used.

    Runs are counted where the rows are and summed by language and bucket, so that at most languages x BUCKETS
    sums reach the driver.
    """
    long_rows(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, body in zip(batch["l"], batch["t"]):
                buckets, counts = gram_counts(body)
                totals.setdefault(language, np.zeros(BUCKETS))[buckets] += counts
        for language, counts in totals.items():
            found = np.flatnonzero(counts)
            yield pd.DataFrame({"l": language, "b": found, "n": counts[found]})

    sums = (
        bounded_sample(rows, "k", "l", most).select("l", "t").mapInPandas(count, "l string, b long, n double")
        .groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(sums["l"].unique())
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, language in enumerate(languages):
        own = sums[sums["l"] == language]
        counts[own["b"].to_numpy(), k] += own["n"].to_numpy()
    return LanguageModel(languages, counts / counts.sum(axis=0) if languages else counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the share of that language) and ``proportions``.

    Null texts and texts without a letter get ``und``, 0.0 and an empty map. Equal shares go to the language with
    the higher likelihood alone, then to the one first in the alphabet. Columns of these names are replaced;
    others stay as they are, and every row is judged on its own.
    """
    shared = sent(docs.sparkSession, model)

    @pandas_udf(RESULT)
    def infer(texts: pd.Series) -> pd.DataFrame:
        model = shared()
        found = [model.proportions(t) for t in texts]
        best = [max(p, key=p.get) if p else UNKNOWN for p in found]
        score = [p.get(b, 0.0) for p, b in zip(found, best)]
        return pd.DataFrame({"lang_pred": best, "score": score, "proportions": found})

    kept = docs.drop("lang_pred", "score", "proportions")
    return kept.withColumn("_found", infer(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], "_found.*")
