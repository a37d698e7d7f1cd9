"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over hashed byte trigrams predicts +1 or
-1 (ridge regression on the square roots of the trigrams' shares).  A text's bits are decoded by loss: the distance to
a codeword is the sum, over its bits, of the logistic loss of the margin, weighted by how well that bit's
classifier does on that language (leave-one-out, known in closed form for ridge regression).  The nearest codeword
wins; a text is flagged ambiguous if the second nearest codeword is not much farther, compared with the training texts.

Up to seven languages get the exhaustive code (all splits of the languages in two); more get that many columns
drawn by a fixed rule, at least fifteen and ten times the logarithm of their number, all different.

Training rows: at most ``per_language`` texts of each language (and 6000 in all, but one of each language), the least by a hash of id and text, so the
sample doesn't depend on partitions.  They are counted on the executors; only their trigram counts reach the driver.

Edge cases: null texts and texts without a letter get ``und`` with score 0, and so do all texts when nothing could
be learned.  Rows whose lang is null aren't learned from.  With one language learned it is always predicted, with
score 1.  Rows without an id are scored but not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_columns, read, trainable

#: Trigram hash buckets, training texts a language, ridge penalty, share of the usual gap to the second codeword below which a text is
#: ambiguous.
BUCKETS, PER_LANGUAGE, RIDGE, MARGIN = 4096, 400, 0.05, 0.4
#: Training texts in all: with many languages each has fewer, but one at least.
IN_ALL = 6000
UNDETERMINED = "und"
# Bytes that are no part of a letter in UTF-8 become blanks.
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def counts(text: str) -> np.ndarray:
    """Trigram counts by bucket."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)


def shares(count: np.ndarray) -> np.ndarray:
    """Square roots of the shares: rows of length 1."""
    total = count.sum(axis=-1, keepdims=True)
    return np.sqrt(count / np.maximum(total, 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n languages, as rows of +1 and -1; no column is constant or equals another or its negative."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = range(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(n)], np.int8)
    drawn, columns = np.random.Generator(np.random.PCG64(7)), {}
    while len(columns) < max(15, int(10 * np.log2(n))):
        column = drawn.integers(0, 2, n) * 2 - 1
        column = column * column[0]
        if abs(column.sum()) < n:
            columns[column.tobytes()] = column
    return np.array(list(columns.values()), np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    scale: float
    gap: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str], ridge: float = RIDGE) -> Model:
        """x: trigram counts, a row a text."""
        languages = sorted(set(names))
        code = code_matrix(len(languages))
        index = np.array([languages.index(s) for s in names], np.int64)
        if len(languages) < 2:
            return cls(languages, code, np.zeros((x.shape[1], 1)), np.ones_like(code, float), 1.0)
        rows = shares(x).astype(np.float64)
        y = code[index].astype(np.float64)
        # Each language counts alike, however many texts it has.
        weight = 1 / np.bincount(index, minlength=len(languages))[index]
        weight *= len(languages) / weight.sum() * len(rows) / len(languages)
        root = np.sqrt(weight)[:, None]
        gram = (rows * root) @ (rows * root).T
        inverse = np.linalg.inv(gram + ridge * np.eye(len(rows)))
        dual = inverse @ (y * root)
        weights = (rows * root).T @ dual
        # Leave-one-out margins: the residual of a left-out row is its dual coefficient over the inverse's diagonal.
        left_out = y - dual / np.diag(inverse)[:, None] / root
        right = np.sign(left_out) == y
        trust = np.array([right[index == k].mean(axis=0) for k in range(len(languages))])
        trust[trust.sum(axis=1) == 0] = 1.0  # a language none of whose bits is learned: all count alike
        trust = trust / trust.sum(axis=1, keepdims=True)
        model = cls(languages, code, weights, trust, 1.0)
        # The scale that makes left-out scores likeliest.
        losses = model._losses(left_out)
        own = np.arange(len(rows)), index
        tried = [2.0**k for k in range(0, 9)]
        model.scale = max(tried, key=lambda s: float(np.log(np.maximum(_soft(-s * losses)[own], 1e-12)).mean()))
        model.gap = float(np.median(_gaps(losses)))
        return model

    def _losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted loss of every text (row) to every codeword (column)."""
        return np.stack([(np.logaddexp(0, -4 * margins * word) * trust).sum(axis=1) for word, trust in zip(self.code.astype(float), self.trust, strict=True)], axis=1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether they are ambiguous."""
        if len(self.languages) == 1:
            return [self.languages[0]] * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        losses = self._losses(shares(x) @ self.weights)
        score, best = _soft(-self.scale * losses), losses.argmin(axis=1)
        return [self.languages[i] for i in best], score.max(axis=1), _gaps(losses) < MARGIN * self.gap


def _gaps(losses: np.ndarray) -> np.ndarray:
    """Difference between the second nearest codeword's loss and the nearest one's."""
    two = np.sort(losses, axis=1)[:, :2]
    return two[:, 1] - two[:, 0]


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(df: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from the rows that are allowed and have a text with a trigram and a language; None if there is none."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), (F.lit(True) if allowed is None else allowed).alias("allowed"))
    rows = rows.filter("allowed AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    per_language = max(1, min(per_language, IN_ALL // len(sizes)))
    # A row is drawn if its hash is below its language's share; twice the bound, so that enough remain.
    share = F.create_map(*(x for s, n in sizes.items() for x in (F.lit(s), F.lit(min(1.0, 2 * per_language / n + 20 / n)))))
    drawn = F.xxhash64(F.lit(1), F.coalesce(F.col("id").cast("string"), F.lit("")), "text")
    rows = rows.withColumn("drawn", drawn).filter((F.pmod("drawn", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])

    def make() -> Callable[..., tuple]:
        return lambda langs, keys, texts: (langs, keys, [zlib.compress(np.minimum(counts(t), 65535).astype("<u2").tobytes(), 1) for t in texts])

    counted = map_columns(rows, ["lang", "drawn", "text"], "lang string, drawn long, counts binary", make).collect()
    by: dict[str, list] = {}
    for r in counted:
        by.setdefault(r["lang"], []).append((r["drawn"] % (1 << 30), r["drawn"], r["counts"]))
    kept = [(s, np.frombuffer(zlib.decompress(c), "<u2")) for s in sorted(by) for _, _, c in sorted(by[s])[:per_language]]
    kept = [(s, c) for s, c in kept if c.any()]
    if not kept:
        return None
    return Model.fit(np.array([c for _, c in kept], np.int64), [s for s, _ in kept])


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred, score (0 to 1), ambiguous."""

    def make():
        def work(keys, texts):
            langs, scores, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            good = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for at in range(0, len(good), 512):
                some = good[at : at + 512]
                for i, *told in zip(some, *model.predict(np.array([counts(texts[i]) for i in some])), strict=True):
                    langs[i], scores[i], unsure[i] = told[0], float(told[1]), bool(told[2])
            return keys, langs, scores, unsure

        return work

    return map_columns(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, lang_pred string, score double, ambiguous boolean", make)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs, trainable()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
