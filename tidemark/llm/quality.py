"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A document becomes a vector of statistics of the whole text (sizes, character classes, repetition, compressibility,
…), each transformed to be nearly symmetric, clipped to the range of the training rows and standardised.  Each class has a mean and a
shrunken covariance: a part of its own, a part of the pooled one and a part of a multiple of the identity.  The
score is the logistic function of the difference of log densities (Mahalanobis distances by the cached
Cholesky factors, and log determinants) and the log ratio of the class sizes, over a temperature.  Shrinkage
and temperature are chosen by three-fold cross-validation on the training rows.

Training rows: at most ``bound`` labelled documents, the least by a hash of the id.  The statistics are taken on the
executors; the driver fits 2 classes of some twenty numbers.  Equal rows of a document (its id repeated with the same text) count once.

Edge cases: null texts count as empty; texts without a word have the same statistics and are scored like all others.  Labels other than 0 and 1 and null labels
aren't learned from.  Without any usable label every other score is 0.5; if all labels are equal, it is that label.
Several labels of a document are all learned from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns, prepare, read, trainable

BOUND, THRESHOLD = 20_000, 0.7
NAMES = (
    "log_chars", "log_words", "word_length", "letters", "digits", "blanks", "stops", "marks", "other_marks", "capitals", "bars", "shouts",
    "distinct_words", "top_word", "repeated_words", "repeated_lines", "line_length", "compressed", "entropy", "short_words", "bare_marks", "word_spread",
)

_CLASS = np.zeros(256, np.int64)  # 0 control, 1 lower letter or part of a multi-byte character, 2 capital, 3 digit, 4 blank, 5 stop, 6 mark, 7 bar, 8 shout
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 1, 1, 2, 3, 4
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = {".": 5, ",": 5, ";": 5, ":": 5, "?": 5, "'": 5, '"': 5, "-": 5, "(": 5, ")": 5, "|": 7, "!": 8}.get(chr(_c), 6)


def statistics(text: str | None) -> np.ndarray:
    """The vector of NAMES; all zero for a text without a word."""
    words = (text or "").split()
    if not words:
        return np.zeros(len(NAMES))
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = np.bincount(_CLASS, weights=bytes_, minlength=9) / len(raw)
    p = bytes_[bytes_ > 0] / len(raw)
    n = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    twice = sum(len(x) for x in lines) - sum(len(x) for x in set(lines))
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return np.array([
        np.log1p(len(text)), np.log1p(n), np.log(lengths.mean()), of[1] + of[2], root(of[3]), of[4], root(of[5]), root(of[6]), root(of[6] + of[7] + of[8]), root(of[2] / max(of[1] + of[2], 1e-9)),
        root(of[7]), root(of[8]), np.log(len(seen)) / np.log(n + 1) if n > 1 else 0.5, root(max(seen.values()) / n), root(sum(a == b for a, b in zip(words, words[1:])) / n),
        root(twice / len(text)), np.log1p(len(text) / max(1, len(lines))), len(zlib.compress(raw, 1)) / (len(raw) + 20), float(-(p * np.log2(p)).sum()),
        float((lengths <= 3).mean()), root(sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" for w in words) / n), np.log1p(lengths.std()),
    ])


@dataclass
class Model:
    """centre, scale, low and high are of the statistics; of each class: log prior, mean, Cholesky factor and the factor's inverse."""

    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    prior: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Difference of the classes' log densities and priors."""
        z = (np.clip(x, self.low, self.high) - self.centre) / self.scale
        density = []
        for prior, mean, factor, inverse in zip(self.prior, self.means, self.factors, self.inverses, strict=True):
            half = np.zeros_like(z)
            for column, part in zip((z - mean).T, inverse.T, strict=True):  # not a matrix product, whose last digits depend on the rows beside
                half += column[:, None] * part
            density.append(prior - 0.5 * (half**2).sum(axis=1) - np.log(np.diag(factor)).sum())
        return (density[1] - density[0]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    @classmethod
    def fit_once(cls, x: np.ndarray, y: np.ndarray, own: float, ridge: float) -> Model:
        low, high = np.quantile(x, [0.001, 0.999], axis=0)
        x = np.clip(x, low, high)
        centre, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale < 1e-9, 1.0, scale)
        z = (x - centre) / scale
        groups = [z[y == k] for k in (0, 1)]
        means = np.array([g.mean(axis=0) for g in groups])
        spread = [(g - m).T @ (g - m) for g, m in zip(groups, means, strict=True)]
        pooled = sum(spread) / len(z)
        factors = []
        for g, s in zip(groups, spread, strict=True):
            mixed = own * s / len(g) + (1 - own) * pooled
            mixed = (1 - ridge) * mixed + ridge * np.trace(mixed) / len(mixed) * np.eye(len(mixed)) + 1e-9 * np.eye(len(mixed))
            factors.append(np.linalg.cholesky(mixed))
        prior = np.log([len(g) / len(z) for g in groups])
        return cls(low, high, centre, scale, prior, means, np.array(factors), np.linalg.inv(factors))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, folds: int = 3) -> Model:
        """Chooses shrinkage and temperature by cross-validated log loss; rows must be in an order free of meaning."""
        fold, best = np.arange(len(y)) % folds, None
        for own in (0.95, 0.7, 0.3):
            for ridge in (0.01, 0.05, 0.2):
                out = np.zeros(len(y))
                for k in range(folds):
                    if min(np.bincount(y[fold != k], minlength=2)) < 2:
                        break
                    out[fold == k] = cls.fit_once(x[fold != k], y[fold != k], own, ridge).logit(x[fold == k])
                else:
                    for t in (1.0, 2.0, 4.0, 8.0, 16.0):
                        loss = np.logaddexp(0, np.where(y == 1, -out, out) / t).mean()
                        if best is None or loss < best[0] - 1e-12:
                            best = loss, own, ridge, t
        _, own, ridge, t = best or (0, 0.5, 0.2, 4.0)
        model = cls.fit_once(x, y, own, ridge)
        model.temperature = t
        return model


def train(df: DataFrame, labels: DataFrame, allowed: Column | None = None, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | float:
    """Learns from at most bound labelled documents; a number is the constant score if there aren't two classes."""
    prepare(df.sparkSession)
    drawn = labels.filter(F.lit(True) if allowed is None else allowed).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    drawn = drawn.withColumn("drawn", F.xxhash64(F.lit(4), "id")).orderBy("drawn", "id", "y").limit(bound)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(drawn), "id")

    def make():
        return lambda keys, y, texts: (keys, y, [statistics(t).tolist() for t in texts])

    found = map_columns(rows, ["drawn", "y", "text"], "drawn long, y int, x array<double>", make).distinct().orderBy("drawn", "y", "x").limit(bound).collect()
    found = sorted((r["drawn"], r["y"], r["x"]) for r in found)
    x, y = np.array([r[2] for r in found]), np.array([r[1] for r in found], np.int64)
    counts = np.bincount(y, minlength=2)
    if min(counts) < 2:
        return 0.5 if not len(y) or counts.min() else float(y[0])
    return Model.fit(x, y)


def classify(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, score (0 to 1), predicted (1 if score reaches the threshold)."""

    def make():
        def work(keys, texts):
            scores = score_texts(texts, model)
            return keys, scores, [int(s >= threshold) for s in scores]

        return work

    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, score double, predicted int", make)


def score_texts(texts: list[str | None], model: Model | float) -> list[float]:
    if isinstance(model, float):
        return [model] * len(texts)
    return model.score(np.array([statistics(t) for t in texts])).tolist() if texts else []


def keep(df: DataFrame, model: Model | float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df's rows whose score reaches the threshold, with df's columns."""
    import pyarrow as pa

    prepare(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([s >= threshold for s in score_texts(batch.column(at).to_pylist(), model)]))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = classify(docs, train(docs, labels, trainable()))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
