"""Quality rules with risk-controlled thresholds.

Every rule is a statistic of a document and a cutoff above which the document is rejected. Cutoffs are chosen per
stratum (language) on labelled documents, in two parts that a hash of the text tells apart. On the first part (one text in
TUNING) all pairs of a rule and a cutoff are put in an order: those that reject few good documents for each bad one come
first. On the second part, the holdout, the pairs are taken in that order, and what all pairs so far reject together is
tested: the exact upper binomial bound (Clopper-Pearson) on the share of good documents rejected must be at most RISK. The
first failure ends it, so no correction is needed within a stratum (a fixed sequence); the error probability is divided by
the number of strata (Bonferroni). What was reached holds together for all rules. A rule without a certified cutoff in a
stratum rejects nothing there.

With no good document rejected, a stratum of n holdout texts needs n >= log(strata / ERROR) / -log(1 - RISK): 217 of them,
so about 290 labelled good texts, with four strata. Below that nothing is certified there. Equal texts count once, as they
aren't independent trials; near copies count each, so the bound is as good as they are few.

Defined cases: a null text has no words; a text without words fails the base rules; a null language is a stratum of
its own; equal rows stay; equal statistics are treated alike (only a statistic above the cutoff rejects); without labels
no cutoff is certified; null labels are left out, and a text is good if any of its labels is 1; a long text is counted
whole, by one task; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, join_checked, slices, table

#: White space between words, as bytes: fixed values.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Good documents that all rules together may reject, and the probability that any stratum's bound doesn't hold.
RISK, ERROR = 0.02, 0.05
#: One labelled text in so many only serves to put the cutoffs in order.
TUNING = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")
#: Statistics, with the candidate cutoffs: fixed grids, so that they don't depend on the data.
RULES = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
    "duplicate_lines": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeated_words": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "sameness": (0.5, 0.6, 0.7, 0.8, 0.9),
    "shortness": (1 / 200, 1 / 100, 1 / 60, 1 / 40, 1 / 30, 1 / 25),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in windows found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    if len(ids) > len(words) - 2:  # a window that comes twice repeats several words
        return 0
    mix = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mix[k : k + n]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return 0
    # Equal hashes are only candidates.
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    rows = codes[maybe[:, None] + np.arange(window)]
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hits = maybe[count[which.ravel()] > 1]
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, hits, 1)
    np.add.at(marks, hits + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of a text."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, stratum (which keeps a null language apart), text_key (a hash of the text) and COUNTS of every document."""
    names = ["doc_id", "lang", "stratum", "text_key", *COUNTS]

    def run(batches):
        for part in slices(batches):
            found = [counts(t) for t in part.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), *(pa.array(x, pa.int64()) for x in columns)], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), stratum.alias("stratum"), F.xxhash64(blank("text")).alias("text_key"), blank("text").alias("text"))
    return arrow(rows, run, f"doc_id {kind}, lang string, stratum string, text_key long, " + ", ".join(f"{x} long" for x in COUNTS))


def statistics() -> dict:
    """A rule's statistic as a column; a text without words has 0 everywhere."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "sameness": F.when(F.col("n_words") >= 50, 1 - F.col("n_distinct_words") / words).otherwise(F.lit(0.0)) * F.least(F.lit(1.0), 2000 / words),
        "shortness": F.when(F.col("n_words") > 0, 1 / words).otherwise(F.lit(0.0)),
    }


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def upper_bound(failed: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest share at which so few failures still have the probability error."""
    if n == 0 or failed >= n:
        return 1.0
    k = np.arange(failed + 1)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
    low, high = failed / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = choose + k * math.log(p) + (n - k) * math.log1p(-p) if p < 1 else np.full(failed + 1, -np.inf)
        top = terms.max()
        below = top + math.log(np.exp(terms - top).sum()) if np.isfinite(top) else -math.inf
        low, high = (p, high) if below > math.log(error) else (low, p)
    return high


TESTS = [(rule, cutoff) for rule, grid in RULES.items() for cutoff in sorted(grid, reverse=True)]


def _order(frames):
    """stratum, and of each of TESTS the good and bad tuning texts it rejects, to the place of each test in the order."""
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            order = sorted(range(len(TESTS)), key=lambda k: ((row[f"g{k}"] + 1) / (row[f"b{k}"] + 1), k))
            rank = [0] * len(TESTS)
            for at, k in enumerate(order):
                rank[k] = at
            out.append((row["stratum"], rank))
        yield pd.DataFrame(out, columns=["stratum", "rank"])


def certified(rank: list[int], first: dict, n: int, risk: float, error: float) -> list[tuple]:
    """(rule, cutoff, rejected, bound) of the tests in their order, until the bound on what all reject together is above risk.

    first: how many good holdout texts the test of each place is the first to reject."""
    out, failed = [], 0
    for at, k in enumerate(sorted(range(len(TESTS)), key=rank.__getitem__)):
        failed += first.get(at, 0)
        bound = upper_bound(failed, n, error)
        if bound > risk:
            break
        out.append((*TESTS[k], failed, bound))
    return out


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected (by all rules up to this cutoff), bound: the certified cutoffs.

    All labelled texts count; what goes beyond aggregates is one row for each stratum."""
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("good"))
    columns = statistics()
    texts = stats.filter(~base_failed()).join(marks, "doc_id").select("stratum", "text_key", "good", *[columns[r].alias(r) for r in RULES])
    texts = cut(texts.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), *[F.max(r).alias(r) for r in RULES]), "labelled")
    tuning = F.pmod(F.xxhash64("text_key", F.lit("tuning")), F.lit(TUNING)) == 0
    fires = [F.col(r) > c for r, c in TESTS]
    # A stratum without tuning texts still gets an order.
    of_tuning = [F.count_if(tuning & f & (F.col("good") == mark)).alias(f"{name}{k}") for k, f in enumerate(fires) for name, mark in (("g", 1), ("b", 0))]
    order = cut(texts.groupBy("stratum").agg(*of_tuning).mapInPandas(_order, "stratum string, rank array<int>"), "order")
    held = join_checked(texts.filter(~tuning & (F.col("good") == 1)), order, ["stratum"])
    first = F.array_min(F.array(*[F.when(f, F.get("rank", F.lit(k))) for k, f in enumerate(fires)]))
    counted = held.groupBy("stratum", "rank", F.coalesce(first, F.lit(len(TESTS))).alias("first")).agg(F.count(F.lit(1)).alias("n"))
    of_stratum = counted.groupBy("stratum", "rank").agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("first"), F.sum("n").alias("n_good"))
    n_strata = of_stratum.agg(F.count(F.lit(1)).alias("n_strata"))

    def certify(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                found = certified(list(row["rank"]), dict(row["first"]), row["n_good"], risk, error / row["n_strata"])
                strictest = {rule: (cutoff, failed, bound) for rule, cutoff, failed, bound in sorted(found, key=lambda x: -x[1])}
                out += [(row["stratum"], rule, cutoff, row["n_good"], failed, bound) for rule, (cutoff, failed, bound) in strictest.items()]
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected", "bound"])

    of_stratum = of_stratum.withColumn("one", F.lit(1)).join(F.broadcast(n_strata.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    return of_stratum.mapInPandas(certify, "stratum string, rule string, cutoff double, n_good long, n_rejected long, bound double")


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, lang, text_key, COUNTS, base_failed, kept, and rejected_by: the rules whose cutoff the document exceeds."""
    stats = cut(measured(documents), "statistics")
    chosen = thresholds(stats, labels, risk, error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    rows = join_checked(stats, cut(chosen, "cutoffs"), ["stratum"], "left")
    broken = [F.when(column > F.col("cutoffs")[rule], F.lit(rule)) for rule, column in statistics().items()]
    rows = rows.withColumn("rejected_by", F.array_compact(F.array(*broken))).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs", "stratum")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
