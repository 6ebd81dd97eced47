"""Regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards its own diagonal and towards the pooled
covariance; Cholesky factors are computed once and travel with the model, so the score of a batch is
two triangular products: the difference of the Mahalanobis log-densities plus the log prior ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import key_and_text, text_groups
from docloom.llm.labelled import GROUP_BYTES, crc_of_id, label_sample, sample_stats
from docloom.llm.text_stats import BASE, EXTRA, all_stats

#: Labelled rows the densities are fitted on, at the most.
SAMPLE_ROWS = 20_000
#: Numerator, denominator and weight of the typical value of each ratio: short texts lean towards the typical text.
RATIOS = (
    ("word_chars", "n_words", 40), ("n_symbols", "word_chars", 200), ("n_dup_lines", "n_lines", 5), ("n_repeat_words", "n_words", 40), ("n_distinct_words", "n_words", 40),
    ("n_upper", "word_chars", 200), ("n_digits", "word_chars", 200), ("n_loud", "word_chars", 200), ("n_stops", "word_chars", 200), ("n_runs", "n_words", 40),
)


def parts(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    named = dict(zip(BASE + EXTRA, stats.reshape(len(stats), len(BASE + EXTRA)).astype(float).T))
    return np.column_stack([named[x] for x, _, _ in RATIOS]), np.column_stack([named[y] for _, y, _ in RATIOS]), np.array([w for *_, w in RATIOS], float)


def typical_ratios(stats: np.ndarray) -> np.ndarray:
    above, below, _ = parts(stats)
    return np.median(above / np.maximum(below, 1), axis=0) if len(stats) else np.zeros(len(RATIOS))


def transformed(stats: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Smoothed ratios on a root scale, so that many zeros and a few large values come closer to a Gaussian."""
    above, below, weight = parts(stats)
    return np.sqrt((above + weight * typical) / (below + weight))


@dataclass
class Discriminant:
    typical: np.ndarray  # of the better class
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # by class
    whiten: np.ndarray  # inverse Cholesky factors, by class
    offset: np.ndarray  # log prior minus half the log determinant, by class

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1 (0.5 where nothing was learned)."""
        x = (transformed(stats, self.typical) - self.centre) / self.scale
        density = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offset)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -40, 40)))


def fit_discriminant(stats: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.1, floor: float = 1e-2) -> Discriminant:
    """A class without rows takes the pooled mean and covariance; without any rows every score is 0.5."""
    width = len(RATIOS)
    typical = typical_ratios(stats[y > 0] if (y > 0).any() else stats)
    x = transformed(stats, typical) if len(stats) else np.zeros((0, width))
    centre, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    x = (x - centre) / scale
    pooled = np.cov(x.T) if len(x) > 1 else np.eye(width)
    means, whiten, offset = [], [], []
    for k in (0, 1):
        own = x[(y > 0) == bool(k)]
        covariance = np.cov(own.T) if len(own) > 1 else pooled
        covariance = (1 - to_pooled) * covariance + to_pooled * pooled
        covariance = (1 - to_diagonal) * covariance + to_diagonal * np.diag(np.diag(covariance)) + floor * np.eye(width)
        factor = np.linalg.cholesky(covariance)
        means.append(own.mean(0) if len(own) else np.zeros(width))
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log((len(own) + 1) / (len(x) + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(typical, centre, scale, np.array(means), np.array(whiten), np.array(offset))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    """Learn labels.quality from rows that aren't held out (crc32 of the id modulo 3 is not 1).

    Labels without an id or a quality teach nothing, an id labelled more than once takes its largest label; null texts count as empty, repeated
    rows count each; other columns are ignored. Without labelled rows every score is 0.5.
    """
    return fit_discriminant(*sample_stats(docs, label_sample(labels, "quality", sample_rows, ~held_out(F.col("doc_id")))))


def score_documents(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted per row of documents.

    Empty and null texts are scored by their (zero) statistics; a null doc_id stays null and isn't held
    out; repeated rows get equal results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, GROUP_BYTES):
            score = model.score(np.array([all_stats(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = key_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
