"""Quality classifier: Bradley-Terry ranking. Document scores are learned from preference pairs by logistic loss on feature differences,
and the threshold is a quantile of the scores of the training rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table

_RATIOS = 18


def features(text: str | None) -> np.ndarray:
    """Counts of the whole text as shares of its bytes, words or lines, each also on a log scale, so that small shares tell apart."""
    x = np.zeros(_RATIOS)
    text = text or ""
    words = text.split()
    if words:
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        n, lines = raw.sum(), [line for line in text.split("\n") if line.strip()]
        marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
        x[:9] = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum(), raw[[35, 42, 36, 37, 38, 124, 60, 62]].sum(), raw[124], raw[33] + raw[63], raw[[44, 46]].sum(), marks, raw[128:].sum()
        x[:9] /= n
        k, distinct = len(words), len(set(words))
        x[9] = sum(a == b for a, b in zip(words, words[1:])) / k
        x[10] = distinct / k
        x[11] = distinct / k**0.5 / 10
        x[12] = sum(w.isupper() and len(w) > 1 for w in words) / k
        x[13] = sum(not w[-1].isalnum() for w in words) / k
        x[14] = min(1.0, len(text) / k / 20)
        x[15] = 1 - len(set(lines)) / len(lines)
        x[16] = min(1.0, np.log1p(k) / 12)
        x[17] = min(1.0, np.log1p(k / len(lines)) / 8)
    return np.concatenate([x, np.log1p(100 * x) / 4.7, [not words]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    cut_score: float = 0.3

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 25, seed: int = 7) -> Model:
    """Newton steps on the pairs' logistic loss. Without rows of both labels no pair exists: all weights are 0 and the score is constant."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * _RATIOS + 1), np.ones(2 * _RATIOS + 1))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    w = np.zeros(x.shape[1] if len(x) else 2 * _RATIOS + 1)
    if not len(good) or not len(bad):
        return Model(mean, scale, w, 0.0, 1.0) if not len(good) and len(bad) else Model(mean, scale, w, -1.0, 2.0)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(y)))
    slopes = np.geomspace(0.05, 5, 60)
    base = np.log(0.3 / 0.7)
    loss = [np.logaddexp(0, -np.where(y == 1, 1, -1) * (a * (s - cut) + base)).mean() for a in slopes]
    return Model(mean, scale, w, cut, float(slopes[int(np.argmin(loss))]))


def _feature_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"x": [features(t).tolist() for t in b["text"]], "y": b["y"].astype("int32")})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most max_rows labelled rows, those of the lowest id hashes, whose crc32(id) mod 5 is not 0. The rows are joined by a
    broadcast of (id, label), whose size max_rows bounds; an id that stands in several rows counts once, with its smallest text and label."""
    sample = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).dropna().where(F.crc32(F.col("_id").cast("string")) % 5 != 0)
    sample = sample.orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows)
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min(F.struct("text", "y")).alias("r")).select("r.*")
    got = rows.mapInPandas(_feature_batches, "x array<double>, y int").toPandas()
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, 2 * _RATIOS + 1))
    order = np.lexsort([*x.T, got["y"].to_numpy()]) if len(got) else []
    return fit(x[order], got["y"].to_numpy()[order])


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(x) for x in t])) if len(t) else np.zeros(0), index=t.index)

    return score(text)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts have features of their own (all zero and a flag) and get a score. A null id is not held out. Repeated rows each
    get a row; ties of scores stay ties. Long texts are scored whole. With no label, or one label value only, all scores are equal. Empty tables give empty results.
    Other columns are neither read nor returned.
    """
    model = train(docs, labels, max_rows, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.cut_score).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The rows of docs that the classifier accepts, with docs' columns, whatever their names.

    Null and empty texts, null ids and repeated rows are scored as in quality_classifier. Without labels of both kinds all rows get one
    score: all go where only label 0 is known, else all stay. An empty table gives an empty result."""
    model = train(docs, labels, max_rows)
    return docs.where(score_column(model, F.col("text")) >= model.cut_score)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
