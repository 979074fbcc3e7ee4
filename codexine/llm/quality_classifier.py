"""Quality classifier: regularised quadratic discriminant analysis.

Documents become a short vector of transformed statistics. Each class has a Gaussian whose covariance is shrunk towards
the pooled covariance and towards its own diagonal. The score is the logistic function of the difference of the two log
densities, from Mahalanobis distances by Cholesky factors that are computed once and kept with the model. Class sums and
sums of products come from all labelled documents of the training folds, in one aggregation.

Defined cases: a null text is the empty text; empty texts have a vector and so a score; labels of null are left out,
repeated labels count each; equal rows stay; if a class has no labelled document, the score is the share of ones (or 0.5
without any label); a long text is read whole, by one task; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, held_out, slices, table
from .quality_rules import SPACE, SYMBOLS, repeated_words

FOLDS, HELD = 4, 2
FEATURES = ("words", "word_length", "symbols", "symbol_words", "lines", "words_per_line", "line_spread", "repeats", "distinct", "longest_run", "pipes", "dup_lines", "capitals", "digits", "punctuation", "sentence_length", "mean_square")
_PUNCTUATION, _DIGITS, _ENDS = b".,;:!?'\"()-", b"0123456789", re.compile(rb"[.!?](?:\s|$)")
#: Towards the pooled covariance, towards the diagonal, and a part of each variance that is added.
SHRINK = (0.1, 0.05, 1e-3)
CUT = 0.7


def features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    n, chars = len(words), max(1, len(data) - (len(data) - len(data.translate(None, SPACE))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    of_lines = np.array([len(x) for x in lines] or [0], float)
    seen: dict[bytes, int] = {}
    longest = run = 0
    last = None
    for w in words:
        run = run + 1 if w == last else 1
        longest = run if run > longest else longest
        last = w
        seen[w] = seen.get(w, 0) + 1
    held = np.array([*seen.values()] or [0], float)
    share = lambda x, of: np.sqrt(x / max(1, of))
    count = lambda which: len(data) - len(data.translate(None, which))
    capitals = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [
        np.log1p(n),
        np.log1p(chars / max(1, n)),
        share(count(SYMBOLS), chars),
        share(sum(w[-1] in SYMBOLS or w[0] in SYMBOLS for w in words), n),
        np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.log1p(of_lines.std() / max(1.0, of_lines.mean())),
        share(repeated_words(words), n),
        np.sqrt(len(seen) / max(1, n)) if n else 1.0,
        np.log(max(1, longest)),
        share(data.count(b"|"), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(capitals, chars),
        share(count(_DIGITS), chars),
        share(count(_PUNCTUATION), chars),
        np.log1p(n / max(1, len(_ENDS.findall(data)))),
        np.log1p((held**2).sum() / max(1, n)),
    ]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and one double for each of FEATURES."""

    def run(batches):
        for part in slices(batches):
            x = np.array([features(t) for t in part.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in x.T)], ["doc_id", *FEATURES])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, " + ", ".join(f"{x} double" for x in FEATURES))


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log densities' constants of class 0 and class 1."""

    mean: np.ndarray
    root: np.ndarray
    constant: np.ndarray
    share: float | None = None

    @classmethod
    def fit(cls, n, sums, products, shrink=SHRINK) -> Discriminant:
        """n, sums and sums of products of each class."""
        n = np.asarray(n, float)
        if n.min() < 2:
            return cls(None, None, None, float((n[1] + 0.5) / (n.sum() + 1)))
        mean = sums / n[:, None]
        own = np.stack([products[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
        pooled = (n[:, None, None] * own).sum(0) / n.sum()
        floor = np.diag(shrink[2] * np.diag(pooled) + 1e-4)
        root, constant = [], []
        for c in (0, 1):
            mixed = (1 - shrink[0]) * own[c] + shrink[0] * pooled
            mixed = (1 - shrink[1]) * mixed + shrink[1] * np.diag(np.diag(mixed)) + floor
            factor = np.linalg.cholesky(mixed)
            root.append(np.linalg.inv(factor))
            constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        return cls(mean, np.stack(root), np.array(constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        density = [self.constant[c] - 0.5 * (((x - self.mean[c]) @ self.root[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def moments(rows: DataFrame, label: str) -> tuple[list, np.ndarray, np.ndarray]:
    """The aggregation that a model needs: two rows, whatever the input."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{k}") for k, f in enumerate(FEATURES)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    n, s, p = [0, 0], np.zeros((2, d)), np.zeros((2, d, d))
    for row in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        c = row[label]
        n[c], s[c] = row["n"], [row[f"s{k}"] for k in range(d)]
        for i, j in pairs:
            p[c, i, j] = p[c, j, i] = row[f"p{i}_{j}"]
    return n, s, p


def classify(documents: DataFrame, labels: DataFrame, train) -> DataFrame:
    """doc_id, score of every document; train: which doc_ids' labels may be learned, as a column."""
    rows = cut(measured(documents), "features")
    learned = labels.filter(train).select("doc_id", "quality")
    model = Discriminant.fit(*moments(rows.join(learned, "doc_id"), "quality"))

    def run(batches):
        for part in batches:
            x = np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", FOLDS, HELD)
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
