"""Quality rules: fixed text measures and a calibrated logistic regression over hashed n-grams.

The regression sees hashed words and character runs of a text, is fitted on labelled rows, and its scores are
turned into probabilities on rows that the fit has not seen. Texts are scored in Arrow batches; thresholds are
fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import bounded_sample, long_rows, sent
from voxsift.llm.textbytes import IS_SPACE, byte_array, char_grams, runs, word_bounds, word_hashes

DIMENSIONS = 1 << 14
TRAIN_DOCS = 3000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document is kept when its calibrated chance of good quality is at least this.
THRESHOLD = 0.5

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measures(data: bytes, starts: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """Number of words, their characters, symbols, repeated lines and words in repeated windows."""
    codes = byte_array(data)
    n_chars = int(np.count_nonzero(((codes & 0xC0) != 0x80) & ~IS_SPACE[codes]))
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split():
            seen.add(line)
    windows = runs(words, WINDOW)
    covered = 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        found = np.flatnonzero(np.isin(windows, twice))
        steps = np.zeros(len(starts) + 1, np.int64)
        steps[found] += 1
        steps[found + WINDOW] -= 1
        covered = int(np.count_nonzero(np.cumsum(steps)[:-1]))
    return len(starts), n_chars, int(np.count_nonzero(IS_SYMBOL[codes])), repeated, covered


def features(codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs of words and runs of three bytes: index and weight, of length one."""
    parts = [grams for grams in (words, runs(words, 2), char_grams(codes, 3)) if len(grams)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    index = (np.concatenate(parts) % np.uint64(DIMENSIONS)).astype(np.int64)
    share = np.repeat([1.0 / len(p) for p in parts], [len(p) for p in parts])
    total = np.bincount(index, weights=share, minlength=DIMENSIONS)
    found = np.flatnonzero(total)
    values = np.sqrt(total[found])
    return found, (values / np.linalg.norm(values)).astype(np.float32)


def parsed(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, their codes, starts and hashes of the words; null is empty."""
    data = (text or "").encode()
    codes = byte_array(data)
    starts, ends = word_bounds(codes)
    return data, codes, starts, word_hashes(codes, starts, ends)


@dataclass
class QualityModel:
    """Weights of the regression, and slope and offset that turn its score into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def chance(self, codes: np.ndarray, words: np.ndarray) -> float:
        index, values = features(codes, words)
        score = float(values @ self.weights[index]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.offset, -500, 500)))


def sparse_rows(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, value and row number of all entries."""
    index = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    return index, values, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


def fit_logistic(entries, truth: np.ndarray, dimensions: int, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a quadratic penalty, by Adam over all rows at each step."""
    index, values, row = entries
    weights, bias = np.zeros(dimensions), 0.0
    first, second = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=values * weights[index], minlength=len(truth)) + bias
        error = 1.0 / (1.0 + np.exp(-np.clip(score, -500, 500))) - truth
        slope = np.bincount(index, weights=values * error[row], minlength=dimensions) / len(truth) + penalty * weights
        slope = np.append(slope, error.mean())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def calibrate(scores: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit; targets are drawn in a little, so that they stay finite."""
    good, bad = truth.sum(), (1 - truth).sum()
    target = np.where(truth > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([scores, np.ones_like(scores)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -500, 500)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> QualityModel:
    """Fits on about ``most`` labelled documents of each class (1 good, 0 bad), a fifth of them for the calibration.

    Rows without label or text are not used. With no row, or only one class, every text gets the same chance.
    """
    long_rows(docs.sparkSession)
    truth = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    chosen = bounded_sample(truth, "k", "y", most)

    @pandas_udf("index binary, value binary")
    def featured(texts: pd.Series) -> pd.DataFrame:
        found = [features(codes, words) for _, codes, _, words in map(parsed, texts)]
        return pd.DataFrame([(i.astype(np.int32).tobytes(), v.tobytes()) for i, v in found], columns=["index", "value"])

    rows = (
        docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k")  # about 2 x most rows
        .select("k", "y", featured("t").alias("f")).select("k", "y", "f.*").toPandas().sort_values(["k", "y"], kind="stable")
    )
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(DIMENSIONS), 0.0, 1.0, 50.0 if not len(y) or y[0] else -50.0)
    hashed = pd.util.hash_array(rows["k"].to_numpy())
    held = hashed % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    parts = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(rows["index"], rows["value"])]
    kept = [p for p, h in zip(parts, held) if not h]
    weights, bias = fit_logistic(sparse_rows(kept), y[~held], DIMENSIONS)
    checked = [p for p, h in zip(parts, held) if h] or kept
    scores = np.array([v @ weights[i] for i, v in checked]) + bias
    return QualityModel(weights, bias, *calibrate(scores, y[held] if held.any() else y))


def judge(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the measures, ``base_failed``, ``chance`` (of good quality) and ``kept``.

    Null and empty texts have no words and fail. Each row is judged on its own, so ties and repeated rows need no
    rule; columns of these names are replaced, others stay.
    """
    shared = sent(docs.sparkSession, model)

    @pandas_udf(f"{MEASURES}, chance double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        model = shared()
        names = [part.split()[0] for part in MEASURES.split(",")] + ["chance"]
        rows = [(*measures(data, starts, words), model.chance(codes, words)) for data, codes, starts, words in map(parsed, texts)]
        return pd.DataFrame(rows, columns=names)

    added = [part.split()[0] for part in MEASURES.split(",")] + ["chance", "base_failed", "kept"]
    base = docs.drop(*added)
    rows = base.withColumn("_found", measured(F.col(text))).select(*[F.col(f"`{c}`") for c in base.columns], "_found.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("chance") >= threshold))
