"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts gives each document a short vector of statistics, kept in the shared folder. The
cosines of random projections approximate a Gaussian kernel on it; the normal equations of the ridge fit
are summed within partitions and then across them, so that the driver gets one matrix of fixed size. A
second aggregate over bins of the raw score gives the isotonic map from score to probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, slices, staged, train_side

#: Fourier features, ridge penalty, bins of the calibration.
FEATURES, RIDGE, BINS = 192, 1.0, 400
NAMES = (
    "log_words", "log_chars", "mean_word", "distinct", "distinct_pairs", "top_word", "upper", "digits", "symbols",
    "exclaim", "pipes", "other_marks", "lines", "dup_lines", "short_words", "space",
)


def statistics_of(text: str) -> list[float]:
    """The vector of one text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, chars = max(1, len(words)), len(raw)
    pairs = set(zip(words, words[1:], strict=False))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n_lines = max(1, len(lines))
    at = lambda s: float(sum(int(hist[ord(c)]) for c in s))
    return [
        np.log1p(len(words)), np.log1p(chars), chars / n, len(counts) / n, (len(pairs) + 1) / n,
        max(counts.values(), default=0) / n, hist[65:91].sum() / chars, hist[48:58].sum() / chars, at("#*$%&<>") / chars,
        at("!?") / chars, at("|") / chars, at("()[]{}=/\\@_~^") / chars, len(lines) / n, 1 - len(set(lines)) / n_lines,
        sum(len(w) < 3 for w in words) / n, (hist[32] + hist[9:14].sum()) / chars,
    ]


@dataclass
class Model:
    """Centre and scale of the statistics, the projection, the ridge weights and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    steps: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.centre) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score keeps the order within a step."""
        raw = self.raw(x)
        bins = np.clip((raw - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(int)
        return np.clip(0.998 * self.steps[bins] + 0.002 * np.clip(raw, 0, 1), 0, 1)


def fourier(z: np.ndarray, seed: int = 11) -> np.ndarray:
    """Cosines of random projections, with a constant: a Gaussian kernel of width the root of the dimension."""
    rng = np.random.default_rng(seed)
    d = len(NAMES)
    w, b = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES - 1)), rng.uniform(0, 2 * np.pi, FEATURES - 1)
    return np.column_stack([np.ones(len(z)), np.cos(np.clip(z, -6, 6) @ w + b) * np.sqrt(2 / (FEATURES - 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The vector ``x`` of each document; null texts are empty ones."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = [statistics_of(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return in_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {id_type}, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _summed(rows: DataFrame, of, schema_len: int) -> np.ndarray:
    """The sum over all rows of ``of(x, y)``, a vector of fixed length: summed in a partition, then across them by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(schema_len)
        for b in batches:
            if b.num_rows:
                total += of(_matrix(b), b.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(schema_len, dtype=np.int32)), pa.array(total)], ["i", "v"])

    parts = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(schema_len)
    for r in parts.collect():  # as many rows as the vector is long
        out[r["i"]] = r["v"]
    return out


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fit to all labelled training rows. Without any, every score is one half."""
    y = labels.where(train_side("doc_id") & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).cast("double").alias("y"))
    rows = staged(stats.join(y, F.col("doc_id") == F.col("_id")).select("x", "y"), "quality_rows")
    d, k = len(NAMES), FEATURES
    sums = _summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), np.square(x).sum(0)]), 2 + 2 * d)
    n = sums[0]
    if not n:
        return Model(np.zeros(d), np.ones(d), np.zeros(k), 0.0, 1.0, np.full(BINS, 0.5))
    centre = sums[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(sums[2 + d :] / n - centre**2, 1e-8))
    corner = np.triu_indices(k)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi = fourier((x - centre) / scale)
        return np.concatenate([(phi.T @ phi)[corner], phi.T @ y])

    sums2 = _summed(rows, normal, len(corner[0]) + k)
    gram = np.zeros((k, k))
    gram[corner] = sums2[: len(corner[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    model = Model(centre, scale, np.linalg.solve(gram + RIDGE * np.eye(k), sums2[len(corner[0]) :]), -0.5, 1.5, np.zeros(BINS))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        b = np.clip((model.raw(x) - model.low) / (model.high - model.low) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)])

    bins = _summed(rows, binned, 2 * BINS)
    rate = sums[1] / n
    weight = bins[:BINS] + 1e-3  # empty bins and ends lean on the overall rate
    model.steps = isotonic((bins[BINS:] + 1e-3 * rate) / weight, weight)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of each row of statistics."""
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model(_matrix(b)))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each document, learnt from the labels' training rows.

    Null texts are empty ones, which are scored like any other. Null ids and repeated rows are scored each for
    itself, equal texts alike; an empty table gives no rows; other columns are not read.
    """
    stats = staged(statistics(docs, id_col, text_col), "quality_stats")
    return score(stats, fit(stats, labels))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, whole rows, that score at or above the threshold.

    Null texts are empty ones. Repeated rows go or stay together, whatever other columns there are; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                x = np.array([statistics_of(t or "") for t in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array(model(x) >= threshold))

    return in_batches(docs).mapInArrow(run, docs.schema)
