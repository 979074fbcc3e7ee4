"""Toxicity by a linear-chain conditional random field.

Each word of a document is tagged clean or toxic. Labelled tokens come from labelled documents: in a toxic document, the
words with a feature (the word, or its beginning) that toxic documents have and clean ones don't, beyond chance. The
field has weights for a word's features and for pairs of neighbouring tags, fitted by gradient ascent on the
likelihood with forward-backward sums. A document is one chain, whatever its length. Its score is a logistic function of
its words' toxic marginals; words whose marginal is at least a half are offending spans, in code points.

The field is fitted on a bounded sample of labelled documents of the training folds: at most SAMPLE toxic and twice as
many clean ones of at most SAMPLE_CHARS characters, the first by a hash of their id. Every document is scored whole.

Defined cases: a null text is the empty text; texts without words have a score, from no marginals; null labels are left
out; equal rows stay and score alike; without toxic or clean labels the score is the share of toxic ones (0.5 without
labels); an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, held_out, slices, table

FOLDS, HELD = 3, 1
SAMPLE, SAMPLE_CHARS = 800, 20_000
#: Words of a part of a chain: parts run side by side.
PART = 64
STEPS, CUT = 60, 0.7
CACHE = 400_000
_EDGE = ".,;:!?\"'()[]{}*#&%$|<>-…"
_WORD = re.compile(r"\S+")


def features(word: str) -> tuple[str, ...]:
    """A word's features, most special first."""
    w = word.lower().strip(_EDGE)
    return ("w=" + w, *(f"{n}={w[:n]}" for n in (5, 4, 3) if len(w) > n), *((f"-{w[-4:]}",) if len(w) > 4 else ()))


def marginals(emissions: np.ndarray, transitions: np.ndarray, sums: bool = False):
    """Toxic marginals of chains x places; with sums, also the log of Z and the expected pairs of tags.

    emissions: the toxic tag's weight over the clean one's, nan after a chain's end."""
    real = ~np.isnan(emissions)
    found = flat_marginals(emissions[real], np.cumsum(real.sum(1)), transitions, sums)
    out = np.zeros(emissions.shape)
    out[real] = found[0] if sums else found
    return (out, *found[1:]) if sums else out


def flat_marginals(emissions: np.ndarray, ends: np.ndarray, transitions: np.ndarray, sums: bool = False, part: int = PART):
    """Toxic marginals of the words of whole chains, one after another; ends: where each chain ends.

    A chain of any length is worked on in parts that run side by side. The product of a part's transfer matrices carries
    the messages over it, so that each part begins and ends with those of the whole chain: the marginals are exact."""
    lengths = np.diff(ends, prepend=0)
    n_parts = -(-lengths // part)
    total = int(n_parts.sum())
    if not total:
        return (emissions, 0.0, np.zeros((2, 2))) if sums else emissions
    first = np.cumsum(n_parts) - n_parts
    place = np.arange(len(emissions)) - np.repeat(ends - lengths, lengths)
    row, at = np.repeat(first, lengths) + place // part, place % part
    odds, real = np.ones((part, total)), np.zeros((part, total), bool)
    odds[at, row], real[at, row] = np.exp(np.clip(emissions, -30, 30)), True
    starts = np.zeros(total, bool)
    starts[first[n_parts > 0]] = True
    (s00, s01), (s10, s11) = np.exp(transitions)
    # carry[a, b]: from tag a before a part to tag b at its end, but for a factor. A chain's first word has no transition.
    carry = np.zeros((2, 2, total))
    carry[0, 0] = carry[1, 1] = 1
    if n_parts.max() > 1:
        for t in range(part):
            x = odds[t]
            a, b, c, d = carry[0, 0], carry[0, 1], carry[1, 0], carry[1, 1]
            now = np.stack([a * s00 + b * s10, (a * s01 + b * s11) * x, c * s00 + d * s10, (c * s01 + d * s11) * x]).reshape(2, 2, total)
            if t == 0:
                now[:, 0, starts], now[:, 1, starts] = 1, x[starts]
            carry = np.where(real[t], now / now.sum((0, 1)), carry)
    # Messages as odds of toxic over clean: before each part, and after its last word.
    before, after = np.ones(total), np.ones(total)
    order = np.argsort(-n_parts, kind="stable")
    many = np.searchsorted(-n_parts[order], -np.arange(1, n_parts.max() + 1), "right")  # chains of so many parts and more
    for k in range(1, int(n_parts.max())):
        own = first[order[: many[k]]] + k
        a, b, c, d = carry[0, 0, own - 1], carry[0, 1, own - 1], carry[1, 0, own - 1], carry[1, 1, own - 1]
        before[own] = (b + before[own - 1] * d) / (a + before[own - 1] * c)
    for k in range(int(n_parts.max()) - 1, 0, -1):
        own = first[order[: many[k]]] + k
        a, b, c, d = carry[0, 0, own], carry[0, 1, own], carry[1, 0, own], carry[1, 1, own]
        after[own - 1] = (c + after[own] * d) / (a + after[own] * b)
    forward, backward = np.empty((part, total)), np.empty((part, total))
    now = before
    for t in range(part):
        step = (s01 + now * s11) / (s00 + now * s10) * odds[t]
        forward[t] = now = np.where(starts, odds[t], step) if t == 0 else step
    now = after
    for t in range(part - 1, -1, -1):
        backward[t] = now
        x = odds[t] * now
        now = np.where(real[t], (s10 + s11 * x) / (s00 + s01 * x), now)
    f, b = forward[at, row], backward[at, row]
    out = f * b / (1 + f * b)
    if not sums:
        return out
    f_before = np.concatenate([[1.0], f[:-1]])
    inner = place > 0
    f_before, x, b_own = f_before[inner], odds[at, row][inner], b[inner]
    each = np.stack([np.full(len(x), s00), s01 * x * b_own, f_before * s10, f_before * s11 * x * b_own])
    pairs = (each / each.sum(0)).sum(1).reshape(2, 2)
    # Z as the product of what each word adds: the sum of its forward message, given the one before as a distribution.
    share = f_before / (1 + f_before)
    z = np.log(1 + odds[at, row][place == 0]).sum() + np.log((1 - share) * (s00 + s01 * x) + share * (s10 + s11 * x)).sum()
    return out, z, pairs


class Field:
    """The fitted field: weights by feature, weights of tag pairs, and the document's logistic function."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias, self.transitions = 0.0, np.zeros((2, 2))
        self.share: float | None = None
        self.document = np.array([0.0, 0.0, 0.0])
        self.cache: dict[str, float] = {}

    def emission(self, word: str) -> float:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            e = self.cache[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return e

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The toxic marginal of every word of all texts, and where each text's words end."""
        words = [t.split() for t in texts]
        ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, int)
        e = np.fromiter((self.emission(w) for x in words for w in x), float, int(ends[-1]) if len(ends) else 0)
        return flat_marginals(e, ends, self.transitions), ends

    def summary(self, marginal: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each document 1, the log odds of its most toxic word, and the log of one more than the expected toxic words."""
        out = np.zeros((len(ends), 3))
        out[:, 0], out[:, 1] = 1, -8
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        full = np.flatnonzero(ends > starts)
        if len(full):
            p = np.clip(marginal, 1e-6, 1 - 1e-6)
            top = np.maximum.reduceat(p, starts[full])
            out[full, 1] = np.clip(np.log(top / (1 - top)), -8, 8)
            out[full, 2] = np.log1p(np.add.reduceat(p, starts[full]))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.summary(*self.tag(texts)) @ self.document, -500, 500)))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of the offending words."""
        if self.share is not None or not text.split():
            return []
        p, _ = self.tag([text])
        return [(m.start(), m.end(), float(x)) for m, x in zip(_WORD.finditer(text), p, strict=False) if x >= least]


def token_labels(texts: list[list[str]], toxic: np.ndarray, chance: float = 1e-6) -> set[str]:
    """Features that toxic documents have beyond chance: if labels were dealt at random, so many of the documents that
    have the feature would be toxic with a probability below chance; at most one in fifty of them may be clean."""
    seen = [Counter(), Counter()]
    for words, t in zip(texts, toxic, strict=True):
        seen[int(t)].update({f for w in set(words) for f in features(w) if f[0] != "-" and f[0] != "3"})
    share = toxic.mean()
    need = math.log(chance) / math.log(max(min(share, 0.999), 1e-9))
    return {f for f, n in seen[1].items() if n >= need and seen[0][f] <= n / 50}


def originals(texts: list[str], keep: int = 24) -> list[int]:
    """The places of texts that aren't near copies of an earlier one: fewer than half of the five-word runs with the
    least hashes stood among an earlier text's. Copies would let one document's words pass for many documents'."""
    seen: dict[int, list[int]] = {}
    out = []
    for k, text in enumerate(texts):
        words = text.split()
        runs = sorted({crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(len(words) - 4, 1))})[:keep]
        shared = Counter(j for r in runs for j in seen.get(r, ()))
        if 2 * max(shared.values(), default=0) < len(runs):
            out.append(k)
            for r in runs:
                seen.setdefault(r, []).append(k)
    return out


def fit(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Field:
    field = Field()
    own = originals(texts)
    texts, toxic = [texts[k] for k in own], np.asarray(toxic, float)[own]
    if not len(toxic) or toxic.min() == toxic.max():
        field.share = float((toxic.sum() + 0.5) / (len(toxic) + 1))
        return field
    words = [t.split() for t in texts]
    telling = token_labels(words, toxic)
    ids: dict[str, int] = {}
    word_ids: dict[str, tuple[list[int], bool]] = {}
    for w in {w for x in words for w in x}:
        fs = features(w)
        word_ids[w] = ([ids.setdefault(f, len(ids)) for f in fs], any(f in telling for f in fs))
    most = max((len(x) for x, _ in word_ids.values()), default=1)
    distinct = {w: k for k, w in enumerate(word_ids)}
    grid = np.full((len(distinct) + 1, most), len(ids))
    marked = np.zeros(len(distinct) + 1, bool)
    for w, (x, tell) in word_ids.items():
        grid[distinct[w], : len(x)], marked[distinct[w]] = x, tell
    flat = np.array([distinct[w] for x in words for w in x], int)
    lengths = np.array([len(x) for x in words])
    gold = marked[flat] & np.repeat(toxic > 0, lengths)
    ends = np.cumsum(lengths)
    inner = np.ones(len(flat), bool)
    inner[(ends - lengths)[lengths > 0]] = False
    inner = np.flatnonzero(inner)
    gold_pairs = np.bincount(2 * gold[inner - 1].astype(int) + gold[inner], minlength=4).reshape(2, 2).astype(float)
    gold_words = np.bincount(flat, gold, len(distinct) + 1)
    n = max(1, len(flat))
    theta = np.zeros(len(ids) + 1 + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, transitions = theta[: len(ids) + 1], theta[len(ids) + 1], theta[-4:].reshape(2, 2)
        emission = (w[grid].sum(1) + bias)[flat]
        p, _, pairs = flat_marginals(emission, ends, transitions, True)
        by_word = gold_words - np.bincount(flat, p, len(distinct) + 1)
        slope = np.zeros_like(theta)
        slope[: len(ids) + 1] = np.bincount(grid.ravel(), np.repeat(by_word, most), len(ids) + 1)
        slope[len(ids)] = 0  # the place of features that a word hasn't
        slope[len(ids) + 1] = by_word.sum()
        slope[-4:] = (gold_pairs - pairs).ravel()
        slope = slope - 0.05 * theta
        slope /= n**0.5
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[len(ids)] = 0
    field.weights = {f: float(theta[k]) for f, k in ids.items() if abs(theta[k]) > 1e-3}
    field.bias, field.transitions = float(theta[len(ids) + 1]), theta[-4:].reshape(2, 2).copy()
    x = field.summary(*field.tag(texts))
    beta = np.array([-1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6)
        beta = beta + np.linalg.solve((x * weight[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (toxic - p) - 0.5 * beta)
    field.document = beta
    field.cache.clear()
    return field


def sample(documents: DataFrame, labels: DataFrame, train, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """The bounded sample that a field is fitted on."""
    rows = documents.select("doc_id", blank("text").alias("text")).filter(F.length("text") <= chars)
    marked = labels.filter(train & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    # Only labels of documents that are there and short enough count towards the bound.
    known = cut(rows.select("doc_id").join(marked, "doc_id").distinct(), "labelled")
    texts, marks = [], []
    for mark, most in ((1, size), (0, 2 * size)):
        # The ids are chosen first, so that only their texts are moved.
        first = known.filter(F.col("toxic") == mark).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        found = rows.join(F.broadcast(first), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
        own = [r["text"] for r in found.select("text").collect()]
        texts += own
        marks += [mark] * len(own)
    return texts, np.array(marks)


def score(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans array<struct<start, end, marginal>> of every document."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            if field.share is not None:
                found, scores = [[]] * len(texts), field.score(texts)
            else:
                p, ends = field.tag(texts)
                scores = 1 / (1 + np.exp(-np.clip(field.summary(p, ends) @ field.document, -500, 500)))
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                found = [[] for _ in texts]
                hits = np.flatnonzero(p >= 0.5)
                of = np.searchsorted(ends, hits, "right")
                for k in np.unique(of):
                    places = dict(zip((hits[of == k] - starts[k]).tolist(), p[hits[of == k]].tolist(), strict=True))
                    found[k] = [{"start": m.start(), "end": m.end(), "marginal": places[i]} for i, m in enumerate(_WORD.finditer(texts[k])) if i in places]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, spans)], ["doc_id", "score", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long,marginal:double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", FOLDS, HELD)
    documents = table(spark, sf_dir, "documents")
    field = fit(*sample(documents, table(spark, sf_dir, "labels"), ~held))
    out = score(documents, field)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
