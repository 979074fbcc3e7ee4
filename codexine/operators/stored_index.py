"""A text index that is kept: built once, it grows by what is new, changed or gone.

An index is a folder of segments, and a manifest of versions that says which count. A segment holds texts (id, digest,
n_tokens) with their words, counted and in order, and sums by token. Rows come in by id: only those whose digest the index
doesn't hold are tokenized, into a new segment; what they replace, and what is removed, is marked dead, with the sums that
it takes along. So weights come from sums over segments, only dead texts' words are read again until segments are merged, and
dead rows meet texts, not postings. A version counts when its manifest is whole; a job that fails leaves the last one. An
index has one writer at a time.

Null ids are left out; of rows that share an id the one of the least digest counts; a null text is the empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import tables
from ..sources.tables import cut
from . import index

#: Segments beyond which an update merges the smaller ones.
SEGMENTS = 8
#: Pairs of a query and a text that a part of a search sums at most.
PAIRS = 500_000
_MANIFEST = "kind string, name string, n long, tokens long"
_TEXT = "digest string, n_tokens long, words array<struct<token:string,tf:long>>"


def parts(spark: SparkSession, path: str) -> list:
    """The rows of the manifest: kind (segment or dead), name, n (texts) and tokens. One for each segment and each set of dead rows."""
    found = tables.current(spark, f"{path}/manifest", _MANIFEST)
    return found.collect() if found is not None else []


def _names(spark: SparkSession, path: str, kind: str) -> list[str]:
    return [r["name"] for r in parts(spark, path) if r["kind"] == kind]


def _read(spark: SparkSession, path: str, kind: str, what: str, schema: str, names: list[str] | None = None) -> DataFrame:
    names = _names(spark, path, kind) if names is None else names
    folders = [f"{path}/{kind}/{n}/{what}" for n in names]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _kind(spark: SparkSession, path: str, rows: DataFrame | None = None) -> str:
    """The type of ids: of the rows, or of the index."""
    if rows is not None:
        return rows.schema["id"].dataType.simpleString()
    name = _names(spark, path, "segment")[0]
    return spark.read.parquet(f"{path}/segment/{name}/texts").schema["id"].dataType.simpleString()


def live(spark: SparkSession, path: str, kind: str, names: list[str] | None = None) -> DataFrame:
    """segment, id, digest, n_tokens, words of all texts that count."""
    rows = _read(spark, path, "segment", "texts", f"segment string, id {kind}, {_TEXT}", names)
    gone = _names(spark, path, "dead")
    return rows.join(_read(spark, path, "dead", "rows", f"segment string, id {kind}, n_tokens long", gone), ["segment", "id"], "left_anti") if gone else rows


def postings(texts: DataFrame) -> DataFrame:
    """id, token, tf, n_tokens of texts with their words."""
    return texts.select("id", "n_tokens", F.explode("words").alias("_p")).select("id", "_p.token", "_p.tf", "n_tokens")


#: Sums by token: texts, times, and of its texts the greatest count and the least spread.
_SUMS = "token string, df long, tf long, max_tf long, min_spread double"


def _write_segment(path: str, texts: DataFrame) -> tuple[str, int, int]:
    """A segment of texts (id, digest, n_tokens, words); its name and totals."""
    spark, name = texts.sparkSession, uuid.uuid4().hex
    texts.select(F.lit(name).alias("segment"), "id", "digest", "n_tokens", "words").write.parquet(f"{path}/segment/{name}/texts")
    own = spark.read.parquet(f"{path}/segment/{name}/texts")
    index.sums(postings(own)).write.parquet(f"{path}/segment/{name}/terms")
    total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).collect()[0]
    return name, total[0], total[1]


def _write_dead(spark: SparkSession, path: str, gone: DataFrame, kind: str) -> tuple[str, int, int]:
    """A set of dead rows (segment, id, n_tokens) with the sums that they take along; its name and totals."""
    name = uuid.uuid4().hex
    gone.select("segment", "id", "n_tokens").write.parquet(f"{path}/dead/{name}/rows")
    rows = spark.read.parquet(f"{path}/dead/{name}/rows")
    held = _read(spark, path, "segment", "texts", f"segment string, id {kind}, {_TEXT}").drop("digest")
    index.sums(postings(held.join(rows.select("segment", "id"), ["segment", "id"], "left_semi"))).write.parquet(f"{path}/dead/{name}/terms")
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).collect()[0]
    return name, total[0], total[1]


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    tables.replace(spark.createDataFrame(rows, _MANIFEST).coalesce(1), f"{path}/manifest")


def update(path: str, rows: DataFrame, id_column: str, text_column: str, whole: bool = False, segments: int = SEGMENTS) -> dict[str, int]:
    """Brings rows into the index: n_new (tokenized) and n_gone (marked dead). whole: rows are all that counts, so texts of other
    ids go; otherwise they stay. The texts of rows that the index holds already are digested, but not tokenized."""
    spark = rows.sparkSession
    given = rows.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).filter("id IS NOT NULL")
    kind = _kind(spark, path, given)
    given = given.withColumn("digest", F.sha2("text", 256))
    names = given.groupBy("id").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("given"))
    known = live(spark, path, kind)
    both = names.join(known.select(F.col("id"), F.col("digest").alias("old"), "segment", "n_tokens"), "id", "full_outer")
    both = cut(both.filter(~F.col("digest").eqNullSafe(F.col("old"))), "changes")
    fresh = given.join(both.filter("digest IS NOT NULL").select("id", "digest"), ["id", "digest"], "left_semi")
    gone = both.filter("old IS NOT NULL" if whole else "old IS NOT NULL AND digest IS NOT NULL")
    manifest = [tuple(r) for r in parts(spark, path)]
    out = {"n_new": 0, "n_gone": 0}
    if both.filter("digest IS NOT NULL").take(1):
        if both.filter("digest IS NOT NULL AND given > 1").take(1):
            fresh = fresh.dropDuplicates(["id"])
        parts_of = text.let(text.tokens("text"), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), index.counted(t).alias("words")))
        segment = _write_segment(path, fresh.select("id", "digest", parts_of.alias("_p")).select("id", "digest", "_p.*"))
        manifest.append(("segment", *segment))
        out["n_new"] = segment[1]
    if gone.take(1):
        dead = _write_dead(spark, path, gone, kind)
        manifest.append(("dead", *dead))
        out["n_gone"] = dead[1]
    if any(out.values()) or not manifest:
        _commit(spark, path, manifest)
    if sum(m[0] == "segment" for m in manifest) > segments:
        merge(spark, path, segments)
    return out


def remove(path: str, ids: DataFrame, id_column: str = "id") -> int:
    """Marks the texts of these ids dead; returns how many those are."""
    spark = ids.sparkSession
    own = ids.select(F.col(id_column).alias("id")).distinct()
    kind = _kind(spark, path, own)
    gone = cut(live(spark, path, kind).select("segment", "id", "n_tokens").join(own, "id", "left_semi"), "gone")
    if not gone.take(1):
        return 0
    dead = _write_dead(spark, path, gone, kind)
    _commit(spark, path, [*map(tuple, parts(spark, path)), ("dead", *dead)])
    return dead[1]


def merge(spark: SparkSession, path: str, segments: int = SEGMENTS) -> None:
    """Writes the smallest segments as one, without their dead rows, until no more than half of so many are left. Only those are
    read and written, with their words as they are: no text is tokenized again."""
    manifest = parts(spark, path)
    own = sorted((m for m in manifest if m["kind"] == "segment"), key=lambda m: (m["n"], m["name"]))
    small = [m["name"] for m in own[: max(0, len(own) - max(1, segments // 2) + 1)]]
    if len(small) < 2:
        return
    kind = _kind(spark, path)
    merged = _write_segment(path, live(spark, path, kind, small))
    kept = [tuple(m) for m in own if m["name"] not in small]
    dead = cut(_read(spark, path, "dead", "rows", f"segment string, id {kind}, n_tokens long").filter(~F.col("segment").isin(small)), "dead")
    more = [("dead", *_write_dead(spark, path, dead, kind))] if dead.take(1) else []
    _commit(spark, path, [*kept, ("segment", *merged), *more])


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes folders that the last version doesn't name, once nobody reads an earlier one; returns how many."""
    used, n = {(m["kind"], m["name"]) for m in parts(spark, path)}, 0
    for kind in ("segment", "dead"):
        for name in tables.folders(spark, f"{path}/{kind}"):
            if (kind, name) not in used:
                tables.remove(spark, f"{path}/{kind}/{name}")
                n += 1
    return n


def weights(spark: SparkSession, path: str) -> DataFrame:
    """token, df, idf, avgdl, max_tf, min_spread, from the sums of segments less those of dead rows. The last two bound what a token
    can add; dead rows may leave them wider than they need be, until segments are merged."""
    own, dead = _read(spark, path, "segment", "terms", _SUMS), _read(spark, path, "dead", "terms", _SUMS)
    less = dead.select("token", F.negative("df").alias("df"), F.negative("tf").alias("tf"), F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("double").alias("min_spread"))
    sums = own.unionByName(less).groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("_tf"), F.max("max_tf").alias("max_tf"), F.min("min_spread").alias("min_spread"))
    sums = cut(sums.filter("df > 0"), "sums")
    n = sum(m["n"] * (1 if m["kind"] == "segment" else -1) for m in parts(spark, path))
    inverse = index.inverse(sums, spark.createDataFrame([(n,)], "n long"))
    return inverse.join(sums.select("token", "max_tf", "min_spread"), "token")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of each query's k best texts: the same as of an index that is made anew. queries: query_id, token, qtf."""
    if not _names(spark, path, "segment"):
        raise ValueError(f"no index at {path}")
    asked = cut(index.weighted(queries, weights(spark, path)), "asked")
    own, all_hits = postings(live(spark, path, _kind(spark, path)).select("id", "n_tokens", "words")), index.ALL_HITS
    if len(asked.select("token").take(index.FEW_TOKENS + 1)) <= index.FEW_TOKENS:
        # Dealt by text, hits are summed where they arise, and only each part's best are moved.
        n = sum(m["n"] for m in parts(spark, path) if m["kind"] == "segment")
        dealt = max(1, -(-n * asked.select("query_id").distinct().count() // PAIRS))
        own, all_hits = own.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").repartition(dealt, "id"), float("inf")
    scored = index.top_bm25(own, asked, k, all_hits)
    return index.top_k(scored.withColumn("score", F.round("score", 9)), k)
