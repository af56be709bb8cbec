"""Quality scores: random Fourier features of document statistics, ridge
regression from partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import by_value, documents, fold

by_value(__name__)

N_FOURIER = 256
BANDWIDTH = 3.0  # width of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-3  # per training row
BINS = 4096  # score histogram of the isotonic fit, over [-1, 2]
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
N_STATS = 20
_SEED = 11


def text_stats(text: str | None) -> list[float]:
    """N_STATS statistics of one whole text; all 0 for a null or blank one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    total = len(raw)
    share = hist[hist > 0] / total
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    blank = hist[9:14].sum() + hist[32]
    marks = total - blank - upper - lower - digits - hist[128:].sum()
    stops = hist[46] + hist[44]
    unique = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = text.split("\n")
    no_lower = sum(map(str.isupper, words))
    titled = sum(map(str.istitle, words))
    letters = max(1, upper + lower + hist[128:].sum())
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        float(upper / letters),
        float(marks / total),
        float((marks - stops) / total),
        float(digits / total),
        float(hist[128:].sum() / total),
        float(unique / n),
        float(np.log1p(unique) / np.log1p(n)),
        float(same / n),
        float(hist[46] / n),
        float(hist[44] / n),
        float(len(lines) / n),
        float(len(set(lines)) / len(lines)),
        float(-(share * np.log2(share)).sum()),
        float(no_lower / n),
        float(titled / n),
        float((lengths <= 3).mean()),
    ]


def _stats(text: pd.Series) -> pd.Series:
    return pd.Series([text_stats(t) for t in text], dtype=object)


def stats_of(text: Column) -> Column:
    return F.pandas_udf(_stats, "array<double>")(text)


@dataclass
class QualityModel:
    """Fixed-size: N_STATS scales, N_FOURIER frequencies, calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray
    prior: float = 1.0

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def fourier(x: np.ndarray) -> np.ndarray:
    """cos(w x + b) with Gaussian w: inner products approximate the kernel; and a constant."""
    rng = np.random.default_rng(_SEED)
    w = rng.normal(size=(x.shape[1], N_FOURIER)) / BANDWIDTH
    b = rng.uniform(0, 2 * np.pi, N_FOURIER)
    return np.c_[np.sqrt(2 / N_FOURIER) * np.cos(x @ w + b), np.ones(len(x))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, N_STATS)


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    """One task's sums of z'z and z'y, a row per feature."""

    def run(batches):
        gram = np.zeros((N_FOURIER + 1, N_FOURIER + 2))
        for pdf in batches:
            for low in range(0, len(pdf), 4096):
                part = pdf.iloc[low : low + 4096]
                z = fourier((_matrix(part["stats"]) - mean) / scale)
                gram += z.T @ np.c_[z, part["quality"].to_numpy(dtype=np.float64)]
        if gram.any():
            yield pd.DataFrame({"feature": np.arange(len(gram)), "sums": [r.tobytes() for r in gram]})

    return run


def _add_rows(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(pdf["sums"])  # a fixed order of addition
    return pd.DataFrame({"feature": [key[0]], "sums": [np.sum([np.frombuffer(r) for r in rows], axis=0).tobytes()]})


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to total / weight."""
    stack: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        stack.append([w, t, 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w2, t2, n2 = stack.pop()
            stack[-1] = [stack[-1][0] + w2, stack[-1][1] + t2, stack[-1][2] + n2]
    return np.concatenate([np.full(n, t / w) for w, t, n in stack])


def _raw_scores(model: QualityModel):
    def run(stats: pd.Series) -> pd.Series:
        return pd.Series(model.raw(_matrix(stats)))

    return F.pandas_udf(run, "double")


def scores_udf(model: QualityModel):
    """Column function: statistics -> calibrated score."""

    def run(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(stats)))

    return F.pandas_udf(run, "double")


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on (doc_id, stats) joined to (doc_id, quality).

    Rows with crc32(doc_id as text) mod 4 = 2, null ids and null labels take no
    part. Several labels of one id count as their mean. What reaches the driver
    is of fixed size: moments, the (features x features) sums and a histogram of
    4,096 bins. Without labelled rows every score is 1 (nothing speaks against
    a text).
    """
    own = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    own = own.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    rows = cut_lineage(stats.join(own, "doc_id").select("stats", "quality"))
    at = [F.col("stats")[i] for i in range(N_STATS)]
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not moments[0]:
        return QualityModel(np.zeros(N_STATS), np.ones(N_STATS), None, np.zeros(1), np.ones(1))
    mean = np.array(moments[1 : N_STATS + 1], dtype=np.float64)
    scale = np.array(moments[N_STATS + 1 :], dtype=np.float64)
    scale[scale < 1e-9] = 1.0
    partial = rows.mapInPandas(_normal_equations(mean, scale), "feature int, sums binary")
    summed = partial.groupBy("feature").applyInPandas(_add_rows, "feature int, sums binary").collect()
    gram = np.array([np.frombuffer(r["sums"]) for r in sorted(summed, key=lambda r: r["feature"])])
    left = gram[:, :-1] + RIDGE * moments[0] * np.diag(np.r_[np.ones(N_FOURIER), 0.0]) + 1e-9 * np.eye(N_FOURIER + 1)
    model = QualityModel(mean, scale, np.linalg.solve(left, gram[:, -1]), np.zeros(1), np.ones(1))
    raw = rows.select(_raw_scores(model)("stats").alias("raw"), "quality")
    spot = F.floor((F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) + 1) * (BINS / 3.0))
    bins = raw.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("y")).orderBy("bin").collect()
    model.knots = np.array([(r["bin"] + 0.5) * 3.0 / BINS - 1 for r in bins])
    model.values = isotonic(np.array([r["n"] for r in bins], dtype=float), np.array([r["y"] for r in bins], dtype=float))
    return model


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), stats_of(F.col(text_col)).alias("stats"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Every whole text is scored from its statistics alone; null and empty texts
    have all statistics 0 and are scored like any other. A null id is not held
    out (and never trains). Repeated rows are scored alike; an empty table
    gives no rows; other columns are not read.
    """
    stats = cut_lineage(document_stats(docs, id_col, text_col))
    model = fit_quality(stats, labels)
    return stats.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        scores_udf(model)("stats").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with all their columns.

    The model is fitted first; texts are then scored where they lie, so no text
    is shuffled.
    """
    model = fit_quality(cut_lineage(document_stats(docs)), labels)
    return docs.where(scores_udf(model)(stats_of(F.col("text"))) >= THRESHOLD)


def op1_quality(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return score_quality(documents(spark, sf_dir, "doc_id", "text"), labels)
