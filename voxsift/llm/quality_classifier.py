"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is the sum of the weights of the hashed words, byte runs and shapes found in it, learned from
labelled documents and calibrated on others. The site it comes from gives its prior: the rate of each path is shrunk
toward that of its host, and the rate of a host toward that of all documents, the more the fewer documents it has.
How much is estimated from the spread of the sites. There are two such rates: of bad quality and of toxic text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import bounded_sample, long_rows, sent
from voxsift.llm.textbytes import IS_SPACE, LOWER, byte_array, char_grams, word_bounds, word_hashes
from voxsift.operators.joins import join_small
from voxsift.staging import stage

HEADS = ("bad", "toxic")
#: Feature numbers: words, runs of six bytes (which hold stems and beginnings), runs of three, then shapes.
WORDS, STEMS, GRAMS = 1 << 20, 1 << 20, 1 << 17
GROUPS = 4
#: Labelled documents of each class that a fit reads.
TRAIN_DOCS = 8000
#: A feature counts if this many labelled documents have it and its share in a class is this far from chance.
LEAST_DOCS, LEAST_Z = 5, 5.0
PRIOR_DOCS = 1.0
THRESHOLD = 0.5
_NO_SITE = "\u0000"
IS_MARK = np.array([33 <= c < 128 and not chr(c).isalnum() for c in range(256)])


def bucket(share: float, steps: int = 20) -> int:
    return min(steps, int(share * steps))


def groups(text: str | None) -> list[np.ndarray]:
    """Feature numbers of a text by group, with repetitions: words, runs of six and of three bytes, shape bins."""
    data = (text or "").encode()
    codes = byte_array(data)
    starts, ends = word_bounds(codes)
    if not len(starts):
        return []
    lower = byte_array(data.translate(LOWER))
    words = word_hashes(lower, starts, ends)
    solid = codes[~IS_SPACE[codes]]
    upper = np.count_nonzero((solid >= 65) & (solid <= 90)) / len(solid)
    marks = np.count_nonzero(IS_MARK[solid]) / len(solid)
    again = np.count_nonzero(words[1:] == words[:-1]) / len(words)
    kinds = len(set(words.tolist()))
    shape = [
        bucket(upper), 32 + bucket(marks), 64 + bucket(kinds / len(words)), 96 + int(np.log2(len(words))),
        128 + min(31, int(len(solid) / len(words))), 160 + bucket(again, 31),
    ]
    return [
        (words % np.uint64(WORDS)).astype(np.int64),
        (char_grams(lower, 6) % np.uint64(STEMS)).astype(np.int64) + WORDS,
        (char_grams(codes, 3) % np.uint64(GRAMS)).astype(np.int64) + (WORDS + STEMS),
        np.array(shape) + (WORDS + STEMS + GRAMS),
    ]


def features(text: str | None) -> np.ndarray:
    """Numbers of the features that a text has, each once."""
    found = groups(text)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def fit_calibration(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights and, last, offset of a logistic fit with a slight penalty; by Newton steps, each halved until it gains."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = np.column_stack([x / scale, np.ones(len(x))])
    theta, keep, sign = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, 0.02), 1e-6), 2 * truth - 1

    def loss(t: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (x @ t)).sum() + 0.5 * (keep * t * t).sum())

    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -500, 500)))
        slope = x.T @ (p - truth) + keep * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6), slope)
        part, now = 1.0, loss(theta)
        while part > 1e-6 and loss(theta - part * step) >= now:
            part /= 2
        if part <= 1e-6:
            break
        theta = theta - part * step
    theta[:-1] /= scale
    return theta


@dataclass
class Evidence:
    """Weight of each feature that counts, and the calibration, for each head.

    Words, runs of either length and shape are weighed apart, each by the sum and by the mean of their weights, because a sum counts
    features that always come together many times over.
    """

    numbers: np.ndarray
    weights: np.ndarray
    calibrations: list[np.ndarray]

    def places(self) -> np.ndarray:
        """Row of ``weights`` for each feature number, or -1."""
        table = np.full(WORDS + STEMS + GRAMS + 256, -1, np.int32)
        table[self.numbers] = np.arange(len(self.numbers))
        return table

    def raw(self, text: str | None, places: np.ndarray) -> np.ndarray:
        """Sums and means of the weights of distinct features: one row for each head."""
        out = np.zeros((len(HEADS), 2 * GROUPS))
        for k, found in enumerate(groups(text)):
            rows = places[found]
            rows = np.unique(rows[rows >= 0])
            out[:, 2 * k] = self.weights[rows].sum(axis=0)
            out[:, 2 * k + 1] = out[:, 2 * k] / max(len(found), 1)
        return out

    def logits(self, text: str | None, places: np.ndarray) -> list[float]:
        return [float(x @ theta[:-1] + theta[-1]) for x, theta in zip(self.raw(text, places), self.calibrations)]


def weight(head: str, n: int, inside: int) -> Column:
    """Log odds of a feature in a class of ``inside`` of ``n`` documents, 0 where its share there is near chance."""
    outside = n - inside
    if not inside or not outside:
        return F.lit(0.0)
    have, rest, share = F.col(head), F.col("n") - F.col(head), F.col("n") / n
    z = (have - inside * share) / F.sqrt(F.greatest(inside * share * (1 - share) * (outside / n), F.lit(1e-9)))
    odds = F.log((have + PRIOR_DOCS * share) / (inside + PRIOR_DOCS)) - F.log((rest + PRIOR_DOCS * share) / (outside + PRIOR_DOCS))
    return F.when(F.abs(z) >= LEAST_Z, odds).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", most: int = TRAIN_DOCS) -> Evidence:
    """Learns from about ``most`` labelled documents of each of the four classes; a fifth is left for the calibration.

    Null labels count as not bad and not toxic; rows without key or text are not used. Without labels there is no
    evidence and every document has even odds on both heads before its site is known; it is then kept.
    """
    long_rows(docs.sparkSession)
    truth = labels.select(
        F.col(key).alias("k"), F.coalesce((F.col(quality) == 0).cast("int"), F.lit(0)).alias("bad"), F.coalesce((F.col(toxic) == 1).cast("int"), F.lit(0)).alias("toxic")
    ).where("k is not null").groupBy("k").agg(F.max("bad").alias("bad"), F.max("toxic").alias("toxic"))
    chosen = bounded_sample(truth.withColumn("kind", F.col("bad") * 2 + F.col("toxic")), "k", "kind", most)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k")  # about 4 x most rows
    rows = stage(rows.select("bad", "toxic", "t", (F.pmod(F.xxhash64("k", F.lit(7)), F.lit(5)) == 0).alias("held")), "labelled")
    fit, held = rows.where("not held"), rows.where("held")

    def count(batches):
        for batch in batches:
            found = [features(t) for t in batch["t"]]
            numbers, at = np.unique(np.concatenate(found), return_inverse=True)
            own = np.repeat(np.arange(len(found)), [len(f) for f in found])
            sums = [np.bincount(at), *(np.bincount(at, weights=batch[h].to_numpy()[own]) for h in HEADS)]
            yield pd.DataFrame({"f": numbers, "n": sums[0], "bad": sums[1].astype(int), "toxic": sums[2].astype(int)})

    sums = fit.select("t", *HEADS).mapInPandas(count, "f long, n long, bad long, toxic long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", *HEADS)))
    totals = fit.agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(h) for h in HEADS)).first()
    weighed = sums.where(F.col("n") >= LEAST_DOCS).select("f", *(weight(h, totals["n"] or 0, totals[h] or 0).alias(h) for h in HEADS))
    used = weighed.where(" or ".join(f"{h} != 0" for h in HEADS)).orderBy("f").collect()  # the few features that tell classes apart
    weights = np.array([[r[h] for h in HEADS] for r in used]).reshape(len(used), len(HEADS))
    evidence = Evidence(np.array([r["f"] for r in used], np.int64), weights, [np.zeros(2 * GROUPS + 1)] * len(HEADS))

    @pandas_udf("array<double>")
    def raw(texts: pd.Series) -> pd.Series:
        places = evidence.places()
        return pd.Series([evidence.raw(t, places).ravel() for t in texts])

    checked = held.select(raw("t").alias("x"), *HEADS).toPandas()
    for k, head in enumerate(HEADS):
        y = checked[head].to_numpy(float)
        if 0 < y.sum() < len(y):
            evidence.calibrations[k] = fit_calibration(np.stack(checked["x"])[:, 2 * GROUPS * k : 2 * GROUPS * (k + 1)], y)
    return evidence


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shrunk(rows: DataFrame, head: str, prior: Column) -> Column:
    """Rate of each group, drawn toward ``prior`` by as many documents as the spread of the groups suggests.

    The spread between groups is what their rates vary beyond chance; with little of it the prior counts for much.
    """
    m = F.col(f"{head}_sum") / F.col("n")
    spread = rows.select("n", m.alias("m"), prior.alias("p")).agg(
        (F.sum(F.col("n") * (F.col("m") - F.col("p")) ** 2) / F.sum("n")).alias("seen"),
        (F.sum(F.col("p") * (1 - F.col("p"))) / F.sum("n")).alias("chance"),
        (F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))) / F.sum("n")).alias("all"),
    ).first()
    between = max((spread["seen"] or 0.0) - (spread["chance"] or 0.0), 1e-6)
    strength = min(max((spread["all"] or 0.0) / between - 1, 1.0), 1e6)
    return (F.col(f"{head}_sum") + strength * prior) / (F.col("n") + strength)


def site_rates(scored: DataFrame) -> DataFrame:
    """``host, path`` with the rates ``site_bad, site_toxic`` and those of all documents, ``all_bad, all_toxic``."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(logistic(F.col(f"logit_{h}"))).alias(f"{h}_sum") for h in HEADS)]
    paths = stage(scored.groupBy("host", "path").agg(*sums), "paths")
    more = [F.sum("n").alias("n"), *(F.sum(f"{h}_sum").alias(f"{h}_sum") for h in HEADS)]
    total = paths.agg(*more).first()
    rate = {h: min(max((total[f"{h}_sum"] or 0.0) / max(total["n"] or 0, 1), 1e-4), 1 - 1e-4) for h in HEADS}
    hosts = paths.groupBy("host").agg(*more)
    hosts = hosts.select("host", *(shrunk(hosts, h, F.lit(rate[h])).alias(f"host_{h}") for h in HEADS))
    rows = paths.join(hosts, "host")
    return rows.select("host", "path", *(shrunk(rows, h, F.col(f"host_{h}")).alias(f"site_{h}") for h in HEADS), *(F.lit(rate[h]).alias(f"all_{h}") for h in HEADS))


def judge(docs: DataFrame, evidence: Evidence, text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD, carry_text: bool = True) -> DataFrame:
    """Adds ``p_bad``, ``p_toxic``, ``site_bad``, ``site_toxic`` and ``kept``; columns of these names are replaced.

    Rows of a null host or path form a site of their own. Null and empty texts have no evidence beyond the calibration's
    offset. Every row is judged by its text and site alone, so repeated rows agree. Evidence is summed by site where the
    rows are, so a hot site moves one row per task. Texts are read once: the rows are staged with their evidence, without
    ``text`` if it isn't to be carried on.
    """
    shared = sent(docs.sparkSession, evidence)

    @pandas_udf("logit_bad double, logit_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        evidence = shared()
        places = evidence.places()
        return pd.DataFrame([evidence.logits(t, places) for t in texts], columns=["logit_bad", "logit_toxic"])

    base = docs.drop("p_bad", "p_toxic", "site_bad", "site_toxic", "kept")
    kept = [F.col(f"`{c}`") for c in base.columns if carry_text or c != text]
    site = [F.coalesce(F.col(c).cast("string"), F.lit(_NO_SITE)) for c in (host, path)]
    row = base.select(F.struct(*kept).alias("row"), site[0].alias("host"), site[1].alias("path"), score(F.col(text)).alias("s"))
    scored = stage(row.select("row", "host", "path", "s.*"), "evidence")
    rates = stage(site_rates(scored.drop("row")), "sites")
    both = join_small(scored, rates, ["host", "path"], spread=F.col("logit_bad"))
    chance = {h: logistic(F.col(f"logit_{h}") + logit(F.col(f"site_{h}")) - logit(F.col(f"all_{h}"))) for h in HEADS}
    return both.select("row.*", *(chance[h].alias(f"p_{h}") for h in HEADS), "site_bad", "site_toxic").withColumn(
        "kept", (F.col("p_bad") <= threshold) & (F.col("p_toxic") <= threshold)
    )
