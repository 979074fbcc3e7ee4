"""Phrases of a dictionary that stand within texts, also inside words.

A dictionary that was counted and is small goes to every task as an automaton, which reads a text once whatever the number
of phrases. A larger one meets texts in an equal join: each phrase by the one of its runs of letters that the fewest
phrases have, each text by all of its runs; what meets is then compared. Both give the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Phrases, and letters of them, up to which a dictionary is an automaton; letters of a run.
FEW, LETTERS, RUN = 20_000, 2_000_000, 3


def _runs(column: str, size: int):
    """The distinct runs of so many letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - size + 1), lambda i: F.substring(F.col(column), i, F.lit(size))))


def _by_automaton(texts: DataFrame, phrases: list[str]) -> DataFrame:
    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in phrases:
            machine.add_word(p, p)
        if phrases:
            machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, body in enumerate(batch.column("body").to_pylist()):
                own = sorted({p for _, p in machine.iter(body)}) if body and phrases else []
                at += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["id", "phrase"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, phrase string")


def _by_runs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Runs are of RUN letters, and of fewer for the phrases that have fewer."""
    out = None
    for size in range(1, RUN + 1):
        own = phrases.filter(F.length("phrase") == size if size < RUN else F.length("phrase") >= size)
        keyed = own.select("phrase", F.explode(_runs("phrase", size)).alias("run"))
        often = keyed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        rarest = keyed.join(often, "run").groupBy("phrase").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
        bodies = texts.filter(F.length("body") >= size)
        met = bodies.select("id", "body", F.explode(_runs("body", size)).alias("run")).join(cut(rarest, "rarest"), "run")
        found = met.filter(F.contains("body", "phrase")).select("id", "phrase")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def within(texts: DataFrame, phrases: DataFrame, few: int = FEW, letters: int = LETTERS) -> DataFrame:
    """id, phrase of every text (id, body) and each distinct phrase (column phrase, not empty) that stands in it, once."""
    own = cut(phrases.select("phrase").filter("phrase <> ''").distinct(), "phrases")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("letters")).collect()[0]
    rows = texts.select("id", "body")
    if size["n"] <= few and size["letters"] <= letters:
        return _by_automaton(rows, [r["phrase"] for r in own.collect()])  # counted: at most few
    return _by_runs(rows, own)
