"""Text and vector indexes as tables, and ranked search over them.

A text index is one table of postings (id, token, tf, n_tokens), made and written once; operators.stored_index keeps one that
grows. Queries are a table too (query_id, token), so many are answered at once; they meet postings in an equal join on the
token, never in a cross join. Where only the k best are wanted, top_bm25 leaves out what can't be among them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import cut

#: Constants of the ranking function, and the share of the mean weight that words of more than half of all texts get.
K1, B, EPSILON = 1.5, 0.75, 0.25


def counted(words: Column) -> Column:
    """token, tf of each different word of an array: words are put in order, and a word's run is as long as its count."""
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i == 0) | (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.struct(F.get(w, i).alias("token"), (F.get(at, k + 1) - i).cast("long").alias("tf")))
    return text.let(F.sort_array(words), lambda w: F.when(F.size(w) > 0, text.let(starts(w), lambda at: runs(w, at))))


def postings(rows: DataFrame, id_column: str, text_column: str, also: tuple[str, ...] = ()) -> DataFrame:
    """id, token, tf, n_tokens: each token of a text once, with its count and the text's length. also: further columns of the text.

    Words are counted within their row, so a task holds one text's at a time and nothing is moved. Rows that share an id and a
    length are one text; only where ids repeat are such rows put together first."""
    own = rows.select(F.col(id_column).alias("id"), *also, F.col(text_column).alias("_x"))
    words = own.select("id", *also, text.tokens("_x").alias("_t")).select("id", *also, F.size("_t").cast("long").alias("n_tokens"), "_t")
    if own.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").take(1):
        words = words.groupBy("id", *also, "n_tokens").agg(F.flatten(F.collect_list("_t")).alias("_t"))
    return words.select("id", *also, "n_tokens", F.explode(counted(F.col("_t"))).alias("_p")).select("id", "_p.token", "_p.tf", "n_tokens", *also)


def query_tokens(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    words = queries.select(F.col(id_column).alias("query_id"), F.explode(text.tokens(text_column)).alias("token"))
    return words.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def idf(posting: DataFrame, n_texts: DataFrame) -> DataFrame:
    """token, df, idf, avgdl; negative weights become a share of the mean weight. The totals are one row each.

    n_texts: one row, n: also texts without tokens count."""
    return inverse(posting.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_tf")), n_texts)


def inverse(df: DataFrame, n_texts: DataFrame) -> DataFrame:
    """token, df, idf, avgdl from sums by token (token, df, _tf)."""
    total = n_texts.join(F.broadcast(df.agg(F.sum("_tf").alias("_all")))).select("n", (F.coalesce("_all", F.lit(0)) / F.col("n")).alias("avgdl"))
    raw = df.join(F.broadcast(total)).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("token", "df", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Rows of query tokens that may be broadcast after they were counted.
FEW_TOKENS = 100_000


def bm25(rows: DataFrame, id_column: str, text_column: str, queries: DataFrame) -> DataFrame:
    """query_id, id, score of every text that shares a token with a query (query_id, token, qtf).

    The index is written once; document frequencies and hits are read from it. If the queries' tokens were counted and are
    few, postings are dealt by text and meet them in a broadcast join, so the many hits of common words are summed where
    they arise. Otherwise both sides are shuffled by token, where Spark splits the common ones."""
    index = cut(postings(rows, id_column, text_column), "postings")
    weights = idf(index, rows.agg(F.count(F.lit(1)).alias("n")))
    asked = queries.join(weights, "token").select("query_id", "token", "qtf", "idf", "avgdl")
    if len(queries.select("token").take(FEW_TOKENS + 1)) <= FEW_TOKENS:
        asked = cut(asked, "asked")
        own = index.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").repartition("id")
        hits = own.join(F.broadcast(asked), "token")
    else:
        hits = index.join(asked, "token")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * part).alias("score"))


#: Postings of a query's rarest words from which the first guess at its k best is taken; and what sums of floats may be off by.
FIRST_HITS, SLACK = 1000, 1e-6
#: The share of a query's least score that its left-out words may add: the more, the fewer postings are read, but the more texts pass.
LEFT_OUT = 0.5
#: Postings of all words that are asked for up to which summing all of them is cheaper than finding out which can be left out.
ALL_HITS = 20_000_000


def weighted(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, token, w, most, df, avgdl: each query word's weight, and the most that it can add to a score.

    queries: query_id, token, qtf; weights: token, df, idf, avgdl, and of the texts that hold the token max_tf and min_spread."""
    w = F.col("qtf") * F.col("idf")
    # A word adds (K1 + 1) / (1 + K1 * ((1 - B) / tf + B / avgdl * n_tokens / tf)), so the least of both parts bounds it.
    least = (1 - B) / F.col("max_tf") + B * F.col("min_spread") / F.col("avgdl")
    most = F.greatest(w * (K1 + 1) / (1 + K1 * least), F.lit(0.0))
    return queries.join(weights, "token").select("query_id", "token", w.alias("w"), most.alias("most"), "df", "avgdl")


def sums(posting: DataFrame) -> DataFrame:
    """token, df, tf, max_tf, and min_spread: the least of a text's tokens for each time that it holds the token; held: its postings.

    A posting with copies stands for so many texts, which df and tf count."""
    times = F.col("copies") if "copies" in posting.columns else F.lit(1)
    return posting.groupBy("token").agg(F.sum(times).cast("long").alias("df"), F.sum(F.col("tf") * times).alias("tf"), F.max("tf").alias("max_tf"), F.min(F.col("n_tokens") / F.col("tf")).alias("min_spread"), F.count(F.lit(1)).alias("held"))


def contribution(tf: Column, n_tokens: Column, avgdl: Column) -> Column:
    """What a word of weight 1 adds to a text: more with tf, less with the text's length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / avgdl))


def _rarest(asked: DataFrame) -> DataFrame:
    """The rarest words of each query, until they have so many postings."""
    before = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    return asked.withColumn("_hits", F.coalesce(F.sum("df").over(before), F.lit(0))).filter(F.col("_hits") < FIRST_HITS).drop("_hits")


def essential(asked: DataFrame, least: DataFrame) -> DataFrame:
    """asked with least (null where a query has no bound), rest and is_essential: words of a query that together can't reach a share of
    its least score aren't; rest is what those add at most. They are those that have most postings for what they can add."""
    by = Window.partitionBy("query_id").orderBy(F.col("most") / F.col("df"), "token")
    rows = asked.join(least, "query_id", "left").withColumn("_sum", F.sum("most").over(by))
    rows = rows.withColumn("is_essential", F.col("least").isNull() | (F.col("_sum") >= LEFT_OUT * F.col("least") - SLACK)).drop("_sum")
    rest = F.coalesce(F.sum(F.when(~F.col("is_essential"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return rows.withColumn("rest", rest)


def top_bm25(posting: DataFrame, asked: DataFrame, k: int, all_hits: int = ALL_HITS) -> DataFrame:
    """query_id, id, score of at least each query's k best texts (ties at the k-th place included): exactly those that bm25 finds.

    posting: id, token, tf, n_tokens, a table that is cheap to read again; asked: of weighted(). The first k texts by a query's
    rarest words are scored exactly; their k-th score is the least that counts. Words that can't reach it together
    bring no texts in. Texts that the others find are dropped where these and the most of the rest stay below it, and only
    what is left meets the rest. A query with fewer than k first texts has no bound, and all of its words count. Where there are
    few postings in all, they are just summed."""
    asked = cut(asked, "asked")
    few = len(asked.select("token").take(FEW_TOKENS + 1)) <= FEW_TOKENS
    small = F.broadcast if few else (lambda df: df)
    if (asked.agg(F.sum("df")).collect()[0][0] or 0) <= all_hits:
        part = F.col("w") * contribution(F.col("tf"), F.col("n_tokens"), F.col("avgdl"))
        return posting.join(small(asked.select("query_id", "token", "w", "avgdl")), "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    own = posting.join(small(asked.select("token").distinct()), "token", "left_semi")
    own = cut(own.repartition("id") if few else own, "own")  # postings of the words that are asked for, dealt by text
    own_part = F.col("w") * contribution(F.col("tf"), F.col("n_tokens"), F.col("avgdl"))

    def found(words: DataFrame) -> DataFrame:
        """query_id, id, score by these words alone."""
        return own.join(small(words.select("query_id", "token", "w", "avgdl")), "token").groupBy("query_id", "id").agg(F.sum(own_part).alias("score"))

    def added(pairs: DataFrame, words: DataFrame) -> DataFrame:
        """query_id, id, more: what these words add to the pairs' texts."""
        wanted = pairs.select("query_id", "id").join(small(words.select("query_id", "token", "w", "avgdl")), "query_id")
        return wanted.join(own, ["id", "token"]).groupBy("query_id", "id").agg(F.sum(own_part).alias("more"))

    first = cut(top_k(found(_rarest(asked)), k).select("query_id", "id"), "first")
    least = added(first, asked).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("more").alias("least")).filter(F.col("_n") >= k).drop("_n")
    asked = cut(essential(asked, least), "essential")
    bounds = asked.select("query_id", "least", "rest").distinct()
    some = found(asked.filter("is_essential")).join(small(bounds), "query_id")
    some = cut(some.filter(F.col("least").isNull() | (F.col("score") + F.col("rest") >= F.col("least") - SLACK)).select("query_id", "id", "score"), "some")
    rest = added(some, asked.filter(~F.col("is_essential")))
    return some.join(rest, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def bm25_top(rows: DataFrame, id_column: str, text_column: str, queries: DataFrame, k: int, all_hits: int = ALL_HITS) -> DataFrame:
    """top_bm25 of texts that no index is kept of, with nine digits."""
    return search_index(rows, id_column, text_column)(queries, k, all_hits)


def search_index(rows: DataFrame, id_column: str, text_column: str) -> Callable[..., DataFrame]:
    """A function of queries (query_id, token, qtf) and k that gives query_id, id, score (nine digits) of at least each query's k best.

    Where at least half of the rows repeat a text, each different text is indexed and scored once, with its number of rows; its
    rows come in by id behind the ranking. The k best rows are among the first k of the k best texts, so that is exact."""
    n_texts = rows.agg(F.count(F.lit(1)).alias("n"))
    keyed = rows.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("_a"), F.xxhash64(F.lit("more"), text_column).alias("_b"))
    texts = cut(keyed.groupBy("_a", "_b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "texts")
    n, different = texts.agg(F.sum("copies"), F.count(F.lit(1))).collect()[0]
    repeated = different * 2 <= (n or 0)
    if repeated:
        one = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")).join(texts.select(F.col("first").alias("id"), "copies"), "id")
        index = cut(postings(one, "id", "_text", ("copies",)), "postings")
        nth = F.row_number().over(Window.partitionBy("first").orderBy("id"))
        members = cut(keyed.join(texts, ["_a", "_b"]).select("first", "id").withColumn("nth", nth), "members")
    else:
        index = cut(postings(rows, id_column, text_column), "postings")
    weights = cut(statistics(index, n_texts), "weights")

    def search(queries: DataFrame, k: int, all_hits: int = ALL_HITS) -> DataFrame:
        scored = top_bm25(index, weighted(queries, weights), k, all_hits).withColumn("score", F.round("score", 9))
        if not repeated:
            return scored
        best = cut(top_k(scored, k).select("query_id", F.col("id").alias("first"), "score"), "best")
        return best.join(members.filter(F.col("nth") <= k), "first").select("query_id", "id", "score")

    return search


def statistics(posting: DataFrame, n_texts: DataFrame) -> DataFrame:
    """What weighted() needs of an index: token, df (its postings), idf, avgdl, max_tf, min_spread. n_texts: one row, n."""
    own = cut(sums(posting), "sums")
    weights = inverse(own.withColumnRenamed("tf", "_tf"), n_texts).drop("df")
    return weights.join(own.select("token", F.col("held").alias("df"), "max_tf", "min_spread"), "token")


def top_k(scored: DataFrame, k: int, score: str = "score", by: tuple = ("query_id",), ties: str = "id") -> DataFrame:
    """Each query's k best, with their rank; ties by id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ties))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def page(scored: DataFrame, k: int, after: DataFrame | None = None) -> DataFrame:
    """The next k of each query in the order of score and id, with their rank on the page. after: query_id, score, id of the row that a
    query's last page ended with (cursors); queries without one have no further page. Without after, the first page.

    A page starts behind a place in the order, not behind a number of rows, so rows that come in or go meanwhile neither
    repeat a row nor leave one out."""
    if after is None:
        return top_k(scored, k)
    mark = after.select("query_id", F.col("score").alias("_score"), F.col("id").alias("_id"))
    rest = scored.join(mark, "query_id").filter((F.col("score") < F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("id") > F.col("_id"))))
    return top_k(rest.drop("_score", "_id"), k)


def cursors(paged: DataFrame, k: int) -> DataFrame:
    """query_id, score, id of the last row of each full page: where the next one starts."""
    return paged.filter(F.col("rank") == k).select("query_id", "score", "id")


def cosine_top(vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int, group: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, id, score of the k best of every group of vectors for each query, so of the k best of all, too.

    queries (query_id, query): any number. Both sides are counted and dealt to groups and blocks by hash; every group meets
    every block in a cell. Scores have nine digits, so that ties go by id however sums are taken. A vector isn't compared
    with the query of its id; null ids and vectors with a null, infinite or undefined element have no score."""

    def fine(df, id_column, vector):
        x = F.col(vector).cast("array<double>")
        return df.select(F.col(id_column).alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & (F.size("v") > 0))

    own, asked = fine(vectors, id_column, vector), fine(queries, "query_id", "query")
    groups, blocks = max(1, -(-own.count() // group)), max(1, -(-asked.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = own.withColumn("_group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("_block", every(blocks))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_group", every(groups))
    key = ["_group", "_block", F.size("v").alias("_size")]

    def matrix(rows):
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
        return rows.column("id").to_numpy(), m, np.sqrt((m * m).sum(1))

    def run(left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, v, length = matrix(left)
            order = np.argsort(ids, kind="stable")
            ids, v, length = ids[order], v[order], length[order]
            query_ids, q, asked_length = matrix(right)
            scores = np.round(q @ v.T / np.maximum(asked_length[:, None] * length[None], 1e-12), 9) + 0.0
            for query_id, row in zip(query_ids, scores, strict=True):
                at = np.flatnonzero(ids != query_id)
                if len(at) > k:
                    at = at[row[at] >= np.partition(row[at], -k)[-k]]
                    at = at[np.argsort(-row[at], kind="stable")[:k]]
                for to, x in zip(out, (np.full(len(at), query_id), ids[at], row[at]), strict=True):
                    to.append(x)
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (right.schema.field("id").type, left.schema.field("id").type, pa.float64()), strict=True)], ["query_id", "id", "score"])

    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, own)]
    return own.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def fuse_weighted(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """0.65 of the cosine plus 0.35 of the lexical score over its maximum, of the first max(4k, 60) of each."""
    n = max(4 * k, 60)
    v = top_k(vector, n).select("query_id", "id", F.col("score").alias("cos"))
    lex = top_k(lexical, n).withColumn("most", F.max("score").over(Window.partitionBy("query_id"))).select("query_id", "id", (F.col("score") / (F.col("most") + 1e-9)).alias("lex"))
    both = v.join(lex, ["query_id", "id"], "full_outer")
    return both.withColumn("score", 0.65 * F.coalesce("cos", F.lit(0.0)) + 0.35 * F.coalesce("lex", F.lit(0.0)))


def fuse_ranks(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Cosine and 0.35 of the normalised lexical score, each with 1 / (60 + rank), summed by id."""
    n = max(4 * k, k)
    v = top_k(vector, n).select("query_id", "id", (F.col("score") + 1 / (60 + F.col("rank"))).alias("part"))
    lex = top_k(lexical, n).withColumn("most", F.max("score").over(Window.partitionBy("query_id")))
    lex = lex.select("query_id", "id", (0.35 * F.col("score") / (F.col("most") + 1e-9) + 1 / (60 + F.col("rank"))).alias("part"))
    return v.unionByName(lex).groupBy("query_id", "id").agg(F.sum("part").alias("score"))


#: Phrase lengths with the weight of a hit and the most that they add: fixed values.
PHRASES = ((5, 0.9, 1.8), (4, 0.7, 1.8), (3, 0.48, 1.6), (2, 0.22, 1.0))


def lexical_score(query_words: Column, folded: Column, words: Column, numbers: Column | None = None) -> Column:
    """Shared words, their share of the query, phrases of the query that stand in the text, and its numbers, each capped."""

    def parts(body: Column, asked: Column) -> Column:
        distinct = F.array_distinct(asked)
        shared = F.size(F.array_intersect(distinct, words))
        score = F.least(F.lit(2.4), 0.22 * shared) + F.when(F.size(distinct) > 0, F.least(F.lit(1.2), 1.8 * shared / F.size(distinct))).otherwise(F.lit(0.0))
        for size, weight, most in PHRASES:
            hits = F.size(F.filter(text.ngrams(asked, size), lambda p: F.contains(body, p)))
            score = score + F.least(F.lit(most), weight * hits)
        if numbers is not None:
            score = score + F.least(F.lit(1.6), 0.45 * F.size(F.filter(numbers, lambda x: F.contains(body, x))))
        return score

    return text.let(folded, lambda body: text.let(query_words, lambda asked: parts(body, asked)))


def rerank(scored: DataFrame, lexical: Column, first: int = 96, most: float = 5.0) -> DataFrame:
    """Adds a lexical score, capped, to the first of each query; the others keep theirs."""
    ranked = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.withColumn("score", F.when(F.col("_rank") <= first, F.col("score") + F.least(F.lit(most), lexical)).otherwise(F.col("score"))).drop("_rank")


def model_boost(scored: DataFrame, model: str = "model_score", first: int = 12, weight: float = 4.0) -> DataFrame:
    """Adds the model's score of the first of each query, scaled from 0 to weight; null model scores add nothing."""
    by = Window.partitionBy("query_id")
    ranked = scored.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    ranked = ranked.withColumn("_m", F.when(F.col("_rank") <= first, F.col(model)))
    low, high = F.min("_m").over(by), F.max("_m").over(by)
    boosted = F.col("score") + F.coalesce(weight * (F.col("_m") - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0))
    return ranked.withColumn("score", boosted).drop("_rank", "_m")


def dedupe(scored: DataFrame, key: list, arrays_of: list[str] = (), bonus: float = 0.0) -> DataFrame:
    """One row for each key: the best score (plus a part of the least one of several, if a bonus is asked for), the row of the best, and unions of arrays."""
    rows = scored.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    keys = [f"_k{i}" for i in range(len(key))]
    plain = [c for c in scored.columns if c not in arrays_of and c not in ("score",)]
    best = F.max_by(F.struct(*plain), F.struct("score", F.negative(F.xxhash64("id")))).alias("_row")
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays_of]
    score = (F.max("score") + F.when(F.count(F.lit(1)) > 1, bonus * F.min("score")).otherwise(F.lit(0.0))).alias("score")
    return rows.groupBy(*keys).agg(score, best, *merged).select("_row.*", "score", *arrays_of)
