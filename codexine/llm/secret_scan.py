"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds, for each blob, the rules with
their versions that were run over it and what they found. A scan runs only the pairs of blob and rule version that the
ledger lacks, appends them, and joins the findings of all blobs back to the paths that hold them.

Defined cases: a null text is the empty text; empty texts have no findings; equal rows stay, each with its findings;
a null path is a path; a long text is scanned whole, by one task; an empty table gives no rows; columns other than the path and the text stay out of the way, as
only those two are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, fresh_path, slices, table, unused

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A header, then lines that are Base64 or the headers of an encrypted key, also with escaped line ends, then the last line if it
#: is there. Prose after a header that stands alone is none of these.
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info): [^\n\\]{1,200}|[A-Za-z0-9+/]{24,}+={0,2}(?![^\s\\-])))*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,76}+={0,2})?+(?:\s|\\[nr])*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?")

#: kind: version, pattern, a literal that any match holds, group and least length that a match must have. In the order of ties.
RULES = {
    "assign": (1, _ASSIGN, (":", "="), 2, 6),
    "access": (1, re.compile(r"AKIA[A-Z0-9]+"), ("AKIA",), 0, 20),
    "hex": (1, re.compile(r"[0-9a-f]{24,}"), (), 0, 24),
    "private_key": (2, _PEM, ("-----BEGIN",), 0, 1),
    "web_token": (1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("eyJ",), 0, 1),
    "forge_token": (1, re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"), ("gh", "glpat-", "xox"), 0, 1),
    "url_password": (2, re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*+:[^\s/@]{3,}+@"), ("://",), 0, 1),
}
BASE = ("assign", "access", "hex")
ORDER = {kind: k for k, kind in enumerate(RULES)}

_FINDING = "struct<start:long,ord:int,end:long,kind:string,version:int>"
_LEDGER = f"blob string, scanned array<string>, findings array<{_FINDING}>"


def find(text: str, kinds) -> list[tuple[int, int, int, str, int]]:
    """(start, order of the kind, end, kind, version) of each match, in code points with the end exclusive, by start."""
    found = []
    for kind in kinds:
        version, pattern, literals, group, least = RULES[kind]
        if not literals or any(x in text for x in literals):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), ORDER[kind], m.end(), kind, version))
    return sorted(found)


def pair(kind: str) -> str:
    """A rule with its version, as the ledger names it."""
    return f"{kind}@{RULES[kind][0]}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {pair(k): k for k in RULES}
    finding = pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("version", pa.int32())])
    for part in slices(batches):
        rules = part.column("pending").to_pylist()
        found = [
            [dict(zip(("start", "ord", "end", "kind", "version"), x, strict=True)) for x in find(text, [kinds[r] for r in todo])]
            for text, todo in zip(part.column("text").to_pylist(), rules, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(rules, pa.list_(pa.string())), pa.array(found, pa.list_(finding))], ["blob", "scanned", "findings"])


def read_ledger(spark: SparkSession, ledger: str, blobs: DataFrame | None = None) -> DataFrame:
    """One row for each blob, with the pairs run over it and the findings by place; of the blobs named only, if some are."""
    rows = spark.read.schema(_LEDGER).parquet(ledger)
    if blobs is not None:
        rows = rows.join(blobs.select("blob"), "blob", "left_semi")
    return rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("scanned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"),
    )


def scan(documents: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", kinds=tuple(RULES), begin: bool = False) -> DataFrame:
    """Scans what the ledger (a folder of Parquet files) lacks, appends it there, and returns path, blob and findings of every row.

    begin: the ledger doesn't exist yet. Only the findings of the current versions of the rules named are returned.
    A blob is scanned once, however many rows hold it: copies are put together before they are moved, so a blob that a
    third of all rows hold is moved once by each task that reads it."""
    spark = documents.sparkSession
    rows = documents.select(F.col(path).alias("path"), blank(text).alias("text")).withColumn("blob", F.sha2("text", 256))
    wanted = F.array(*[F.lit(pair(k)) for k in kinds])
    fresh = rows.groupBy("blob").agg(F.any_value("text").alias("text"))
    if begin:
        fresh = fresh.withColumn("pending", wanted)
    else:
        done = read_ledger(spark, ledger, rows.select("blob").distinct()).select("blob", "scanned")
        fresh = fresh.join(done, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("scanned", F.array().cast("array<string>"))))
        fresh = fresh.filter(F.size("pending") > 0)
    arrow(fresh.select("blob", "text", "pending"), _scan, _LEDGER).write.mode("append").parquet(ledger)
    current = F.array(*[F.lit(pair(k)) for k in kinds])
    seen = read_ledger(spark, ledger, None if begin else rows.select("blob").distinct())
    seen = seen.select("blob", F.filter("findings", lambda x: F.array_contains(current, F.concat(x["kind"], F.lit("@"), x["version"].cast("string")))).alias("findings"))
    # As a table of its own, so that Spark may split the join where many paths hold one blob.
    return rows.select("path", "blob").join(cut(seen, "findings"), "blob")


def _joined(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda x: x["kind"] == kind


def redact(documents: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """documents with every span in findings (blob, findings) replaced by its kind in brackets; spans that overlap become one.

    The columns that this needs meanwhile have names that documents doesn't hold."""
    blob, found = unused(documents, "blob"), unused(documents, "findings")
    blobs = findings.select(F.col("blob").alias(blob), F.col("findings").alias(found)).filter(F.size(found) > 0).distinct()
    rows = documents.withColumn(blob, F.sha2(blank(text), 256)).join(blobs, blob, "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, findings: pd.Series) -> pd.Series:
        return pd.Series([t if f is None else replaced(t, f) for t, f in zip(texts, findings, strict=True)], dtype=object)

    return rows.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(cleaned(F.when(F.col(found).isNotNull(), F.col(text)), found))).drop(blob, found)


def replaced(text: str, findings) -> str:
    out, at = [], 0
    for x in findings:
        start, end, kind = (x["start"], x["end"], x["kind"])
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of every document's findings, from a ledger that begins empty."""
    found = scan(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"), begin=True)
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(F.filter("findings", _of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )
