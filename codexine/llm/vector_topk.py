"""Exact top-k search by block-at-a-time pruning.

Vectors become integers, floor(64 * x). Candidates are put in order of vec_id and packed into groups of document-range
blocks; each block has a forward index (its integer matrix) and, for every dimension, its greatest and least value. For
a query, a block's bound is the sum over dimensions of the greatest product possible. Blocks are visited in the order of
their bounds, and a query stops when the next bound is below its k-th score. Packed queries meet packed groups in cells,
one group against one pack of queries, so that no task holds all of either; the best of all cells are merged.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; of vectors of
different lengths the shared dimensions count; a query's own row is every row of its id; queries that repeat an id are
answered each; equal scores go by vec_id; fewer candidates than k give fewer rows; extra columns aren't read; an empty
table gives no rows; an integer or a score beyond 64 bits counts as the nearest one within.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, cut, table

K, SCALE, EVERY = 20, 64, 20
BLOCK, GROUP, PACK = 128, 4096, 1024
_PACKED = "part int, seq int, n int, dims int, ids binary, cells binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long> of the rows that take part."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a partition, in order of vec_id, as matrices of at most size rows."""

    def run(batches):
        part, seq, ids, cells = TaskContext.get().partitionId(), 0, [], []

        def out(n):
            nonlocal seq, ids, cells
            own, ids, matrix, cells = ids[:n], ids[n:], cells[:n], cells[n:]
            dims = max(map(len, matrix))
            full = np.zeros((len(own), dims), np.int64)
            for k, x in enumerate(matrix):
                full[k, : len(x)] = x
            kind = np.int32 if -(2**31) <= full.min(initial=0) and full.max(initial=0) < 2**31 else np.int64
            row = [part, seq, len(own), dims, np.array(own, np.int64).tobytes(), bytes([kind == np.int64]) + full.astype(kind).tobytes()]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "seq", "n", "dims", "ids", "cells"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            cells += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield out(size)
        if ids:
            yield out(size)

    return arrow(rows.sortWithinPartitions("vec_id"), run, _PACKED)


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    cells = np.frombuffer(row["cells"], np.int64 if row["cells"][0] else np.int32, offset=1)
    return np.frombuffer(row["ids"], np.int64), cells.reshape(row["n"], row["dims"]).astype(np.int64)


def search(ids, vectors, query_ids, queries, k: int = K, block: int = BLOCK, visited: list | None = None):
    """(query's place, vec_id, score) arrays of each query's k best, from blocks in the order of their bounds."""
    dims = min(vectors.shape[1], queries.shape[1])
    vectors, queries = vectors[:, :dims], queries[:, :dims]
    far = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))  # noqa: E731  the least integer has no positive one
    kind = np.float64 if far(vectors) * far(queries) * max(dims, 1) < 2**53 else object
    within = (lambda x: x) if kind is not object else (lambda x: np.minimum(np.maximum(x, -(2**63)), 2**63 - 1))
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    starts = range(0, len(ids), block)
    most = np.stack([vectors[s : s + block].max(0) for s in starts])
    least = np.stack([vectors[s : s + block].min(0) for s in starts])
    plus, minus = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bounds = within(plus @ most.T + minus @ least.T)  # queries x blocks
    order = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, kind))] * len(queries)
    kth = [None] * len(queries)
    open_ = np.arange(len(queries))
    for step in range(len(most)):
        open_ = np.array([q for q in open_ if kth[q] is None or bounds[q, order[q, step]] >= kth[q]], int)
        if not len(open_):
            break
        at = order[open_, step]
        if visited is not None:
            visited.append(len(open_))
        for b in np.unique(at):
            asked = open_[at == b]
            own = ids[b * block : (b + 1) * block]
            scores = within(queries[asked] @ vectors[b * block : (b + 1) * block].T)
            for q, row in zip(asked, scores, strict=True):
                other = own != query_ids[q]
                keep = other if kth[q] is None else other & (row >= kth[q])
                if keep.any():
                    at_ids, at_scores = np.concatenate([best[q][0], own[keep]]), np.concatenate([best[q][1], row[keep]])
                    top = np.lexsort((at_ids, -at_scores))[:k] if kind is not object else np.array(sorted(range(len(at_ids)), key=lambda i: (-at_scores[i], at_ids[i]))[:k])
                    best[q] = (at_ids[top], at_scores[top])
                    if len(top) == k:
                        kth[q] = best[q][1][-1]
    place = np.repeat(np.arange(len(queries)), [len(x) for x, _ in best])
    return place, np.concatenate([x for x, _ in best]), np.array([int(s) for _, x in best for s in x], np.int64)


def top_k(vectors: DataFrame, is_query, k: int = K, group: int = GROUP, pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = cut(integers(vectors), "vectors")
    n = rows.count()
    groups = cut(packed(rows.repartitionByRange(max(1, -(-n // group)), "vec_id"), group), "groups")
    asked = cut(packed(rows.filter(is_query).repartitionByRange(max(1, -(-n // (group * 4))), "vec_id"), pack), "queries")

    def numbered(df, name):
        """With numbers from 0 without gaps; the driver sees one count for each partition."""
        sizes = {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        start, at = {}, 0
        for p in sorted(sizes):
            start[p], at = at, at + sizes[p]
        starts = spark.createDataFrame(list(start.items()) or [(-1, 0)], "part int, first int")
        return df.join(F.broadcast(starts), "part").withColumn(name, F.col("first") + F.col("seq")).drop("part", "seq", "first"), at

    groups, n_groups = numbered(groups, "g")
    asked, n_packs = numbered(asked, "q")
    groups = groups.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(n_packs - 1, 0)))))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(max(n_groups - 1, 0))))).select("q", "g", *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "cells")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = _matrix(row)
                query_ids, queries = _matrix({c: row[f"q_{c}"] for c in ("n", "dims", "ids", "cells")})
                place, vec_ids, scores = search(ids, matrix, query_ids, queries, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[place], pa.int64()), pa.array(place + row["q"] * pack, pa.int64()), pa.array(vec_ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "asked", "vec_id", "score"])

    cells = groups.join(asked, ["g", "q"])
    found = arrow(cells, run, "query_id long, asked long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH fine AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
