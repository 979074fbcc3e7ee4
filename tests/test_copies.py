"""Searches over tables whose rows repeat each other: each different text is scored once, and no row that counts is lost."""

from pyspark.sql import functions as F

from codexine.operators import index
from codexine.plans import routes


def _law(spark, n=400):
    rows = spark.range(n).select("id", F.concat(F.lit("Mức phạt vượt đèn đỏ mức "), (F.col("id") % 5).cast("string")).alias("rag_text"), F.lit("Nghị định 168/2024/NĐ-CP").alias("document"))
    return rows.select("*", (6 + F.col("id") % 2).cast("string").alias("article"), F.lit("1").alias("clause"), F.when(F.col("id") % 3 == 0, "a").otherwise("").alias("point"))


def test_copies_are_scored_once_with_the_same_result(spark):
    rows = _law(spark)
    asked = index.query_tokens(spark.createDataFrame([(1, "mức 3 mức 3 phạt"), (2, "đèn 4 mức 1")], "query_id long, question string"), "query_id", "question")
    every = index.bm25(rows, "id", "rag_text", asked).withColumn("score", F.round("score", 9))
    few = index.bm25_top(rows, "id", "rag_text", asked, 7)
    out = lambda df, k: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in index.top_k(df, k).collect())
    assert out(few, 7) == out(every, 7)
    assert few.count() <= 2 * 5 * 7 < every.count()


def test_exact_references_keep_what_can_remain(spark):
    rows, k = _law(spark), 8
    kept = {(r["article"], r["id"]) for r in routes._exact(rows).collect()}
    assert len(kept) <= 2 * (routes.RERANKED + 10)
    for article in "67":
        own = sorted(r["id"] for r in rows.filter(F.col("article") == article).collect())
        assert {(article, i) for i in own[: routes.RERANKED]} <= kept
    questions = spark.createDataFrame([(1, "Chi tiết Điều 6 mức 3"), (2, "Điều 7 vượt đèn đỏ")], "query_id long, question string")
    hits = routes.search(rows, questions, 3 * k).select("query_id", "id", "score")
    refs = questions.select("query_id", F.when(F.col("query_id") == 1, "6").otherwise("7").alias("article"))
    both = hits.unionByName(refs.join(rows, "article").select("query_id", "id", F.lit(5.0).alias("score"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    full = both.join(rows, "id").join(questions, "query_id")
    whole = index.top_k(routes.deduped(routes.reranked(full), routes.place(rows)), k)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    assert plain(routes.general(rows, questions, k)) == plain(whole)


def test_rows_that_are_alike_are_one(spark):
    rows = routes.corpus(_law(spark))
    hits = spark.createDataFrame([(77,)], "id long")
    kept = sorted(r["id"] for r in routes.representatives(rows, hits).collect())
    first = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        first.setdefault((r["rag_text"], r["article"], r["point"]), r["id"])
    assert kept == sorted({*first.values(), 77})
