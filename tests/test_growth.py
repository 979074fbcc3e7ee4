"""Joins whose work must not grow with the square of a group."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codexine import plans
from codexine.functions import cleaning
from codexine.operators import answers, assets, chunking, evaluation, grams, graph, index, joins, phrases, sanctions, sequences, spatial, stored_index, truth, windows
from codexine.sources import buckets


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_boxes_dealt_to_cells_are_not_broadcast(spark):
    boxes = spark.createDataFrame([(1, i, 10.0 * i, 5.0 * i, 10.0 * i + 30, 5.0 * i + 8) for i in range(20)], "page long, id long, x0 double, y0 double, x1 double, y1 double")
    for out in (spatial.nearest_caption(boxes, boxes, ["page"]), spatial.best_overlap(boxes, boxes, ["page"], 64)):
        assert "BroadcastHashJoin" not in _plan(out)


def test_siblings_meet_the_first_nodes_of_their_keys(spark):
    r = random.Random(3)
    nodes = [(i, r.choice("ab"), r.choice("xyz")) for i in range(200)] + [(5, "a", "x")]
    seeds = [(i, r.choice("abc"), r.choice("xyz")) for i in range(0, 200, 9)]
    make = lambda rows: spark.createDataFrame(rows, "id long, article string, clause string")
    out = graph.same_reference(make(nodes), make(seeds), ["article", "clause"], [0.55, 0.28], 5)
    want = set()
    for s, a, c in seeds:
        cost = {}
        for i, x, y in nodes:
            if i != s and x == a:
                cost[i] = min(cost.get(i, 9), 0.28 if y == c else 0.55)
        want |= {(s, i, w) for w, i in sorted((w, i) for i, w in cost.items())[:5]}
    assert {(x["seed"], x["id"], x["cost"]) for x in out.collect()} == want
    # One ranking for each number of shared keys, and one of a seed's siblings.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 3


def test_nearest_carries_places_in_order(spark):
    r = random.Random(5)
    left = [(i, r.choice([1, 2, None]), r.choice([None, r.randrange(-900, 900)])) for i in range(150)]
    right = [(r.choice([1, 2, None]), r.choice([None, r.randrange(-900, 900) // 7 * 7]), i) for i in range(120)]
    out = joins.nearest_join(spark.createDataFrame(left, "k long, g long, at long"), spark.createDataFrame(right, "g long, place long, v long"), ["g"], "k", "at", "place", 60, ["v"])
    want = set()
    for k, g, at in left:
        near = sorted((abs(at - p), p, v) for h, p, v in right if None not in (g, at, p) and h == g and abs(at - p) <= 60)
        if near:
            want.add((k, near[0][0], near[0][2]))
    assert {(x["k"], x["distance"], x["near_v"]) for x in out.collect()} == want
    assert "explode" not in _plan(out)


def test_records_that_are_alike_are_scored_once(spark, monkeypatch):
    records = spark.range(300).select("id", F.lit("c").alias("chunk"), F.lit("d").alias("document"), F.lit("6").alias("article"), (F.col("id") % 3).cast("string").alias("clause"), F.lit("").alias("point"), F.lit("đèn đỏ").alias("text"))
    cases = spark.range(2).select(F.col("id").alias("case_id"), truth.legal_basis(F.lit("khoản 1 Điều 6"), F.lit("d")).alias("ref"), F.lit("đèn đỏ").alias("quote"))
    made, cut = {}, truth.cut
    monkeypatch.setattr(truth, "cut", lambda df, what="cut": made.setdefault(what, cut(df, what)))
    got = sorted((x["case_id"], x["chunk"], x["id"], x["score"], x["rank"]) for x in truth.expected_chunks(cases, records).collect())
    assert got == [(0, "c", 1, 7.0, 1), (1, "c", 1, 7.0, 1)]
    assert made["records"].count() == 3


def test_lexical_search_moves_no_text_to_each_pair(spark):
    r = random.Random(7)
    words = [a + b for a in ("bal", "cor", "dim", "fen", "gus") for b in ("ta", "re", "mi")]
    rows = [(i, r.choice("xy"), " ".join(r.choices(words, k=r.randrange(0, 25)))) for i in range(120)]
    asked = [(i, " ".join(r.choices(words, k=r.choice([2, 4, 9]))), r.choice([[], ["x"]])) for i in range(8)]
    rows_df, asked_df = spark.createDataFrame(rows, "id long, document string, text string"), spark.createDataFrame(asked, "query_id long, question string, documents array<string>")
    out = truth.lexical_only(rows_df, asked_df, 6)
    want = set()
    for q, question, inside in asked:
        own = question.split()
        runs = list(dict.fromkeys(" ".join(own[i : i + n]) for n in (5, 4, 3) for i in range(len(own) - n + 1)))[:24]
        runs = [x["p"] for x in asked_df.filter(F.col("query_id") == q).select(F.explode(truth.subject_phrases("question")).alias("p")).collect()] if runs or len(own) < 5 else runs
        scored = []
        for i, document, body in rows:
            n = len(set(own) & set(body.split()))
            if n and (not inside or document in inside):
                scored.append((-round(min(n, 30) * 0.15 + sum(p in body for p in runs) + (2.0 if inside else 0.0), 6), i))
        want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scored)[:6])}
    assert {(x["query_id"], x["id"], round(x["score"], 6), x["rank"]) for x in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in "".join(line for line in plan.splitlines() if "Aggregate [query_id" in line and "count(1)" in line)


def test_terms_by_phrases_are_those_by_runs(spark):
    rows = spark.createDataFrame([(1, "red lamp post"), (2, "lamp"), (3, "the post"), (4, None)], "id long, body string")
    groups = spark.createDataFrame([(1, 0, "lam"), (1, 1, "st"), (1, 1, ""), (2, 0, "p p"), (3, 0, "x"), (4, 0, "po"), (4, 1, "e")], "query_id long, part int, term string")
    plain = lambda df: sorted((x["query_id"], x["id"]) for x in df.collect())
    by_runs = grams.matching(grams.postings(rows, "id", "body"), groups)
    held = phrases.within(rows, groups.select(F.col("term").alias("phrase"))).withColumnRenamed("phrase", "term")
    assert plain(grams.met(groups, held)) == plain(by_runs) == [(1, 1), (2, 1), (4, 1), (4, 3)]


def test_table_rows_are_not_moved_to_each_question(spark, monkeypatch):
    rows = spark.range(300).select("id", F.lit(0).alias("row_index"), F.concat(F.lit("alpha beta row "), F.when(F.col("id") == 250, "7").otherwise("x")).alias("row_text"))
    asked = spark.createDataFrame([(1, "alpha beta 7"), (2, "alpha gamma")], "query_id long, question string")
    met, within = [], phrases.within
    monkeypatch.setattr(answers.phrases, "within", lambda texts, named: met.append(named.count()) or within(texts, named))
    got = [(x["query_id"], x["id"], round(x["score"], 6)) for x in answers.table_row_scores(rows, asked, 3).orderBy("query_id", "rank").collect()]
    # By words alone 0.22 of the first question, 0.11 (too little) of the second; the number brings in the one row that has it.
    assert got[0][:2] == (1, 250) and [x[:2] for x in got[1:]] == [(1, 0), (1, 1)] and got[1][2] == 0.97
    assert met


def test_words_are_counted_within_their_row(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choices("abcde", k=r.randrange(0, 12)))) for i in range(40)] + [(40, None)]
    again = [(3, rows[3][1]), (5, "a b"), (None, "c c"), (None, "c c")]
    for given in (rows, rows + again):
        df = spark.createDataFrame(given, "id long, t string")
        out = index.postings(df, "id", "t")
        want = {}
        for i, t in given:
            words = (t or "").split()
            for w in words:
                want[i, w, len(words)] = want.get((i, w, len(words)), 0) + 1
        assert sorted(((x["id"], x["token"], x["n_tokens"], x["tf"]) for x in out.collect()), key=str) == sorted(((*k, n) for k, n in want.items()), key=str)
        # A task that counts by id and word holds all words of its texts at once.
        if given is rows:
            assert "Aggregate" not in _plan(out) and "Exchange" not in _plan(out)


def test_unrelated_texts_of_common_words_are_not_paired(spark, tmp_path, monkeypatch):
    r = random.Random(13)
    words = [a + b for a in ("bal", "cor", "dim", "fen", "gus", "hol") for b in ("ta", "re", "mi", "no", "lu")]
    texts = [" ".join(r.choices(words, k=r.randrange(20, 60))) for _ in range(150)]
    near = [t + " ta" for t in texts[:9]] + ["bal"]
    spark.createDataFrame(list(enumerate([*texts, *near])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    met, plain = [], sequences._met
    monkeypatch.setattr(sequences, "_met", lambda *given: met.append(plain(*given)) or met[-1])
    got = sorted((x["a"], x["b"]) for x in plans.QUERIES["sequence_pairs"](spark, str(tmp_path)).collect())
    assert got == [(i, 150 + i) for i in range(9)]
    assert sum(x.count() for x in met) < 20


def test_sets_that_differ_are_settled_where_they_meet(spark, monkeypatch):
    r = random.Random(17)
    words = [f"w{i}" for i in range(34)]
    sets = list({frozenset(r.sample(words, r.choice([1, 2, 4, 5, 9, 14, 20, 24, 28]))) for _ in range(170)})
    sets += [s ^ {"new"} for s in sets[:40]]
    made, cut = {}, evaluation.cut
    monkeypatch.setattr(evaluation, "cut", lambda df, what="cut": made.setdefault(what, cut(df, what)))
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(999, None), (998, [])], "id long, words array<string>")
    got = {(x["a"], x["b"]) for x in evaluation.near_pairs(rows, "id", "words", 0.8).collect()}
    both = lambda least: {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= least * len(a | b)}
    assert got == both(0.8) and len(got) > 30
    # Pairs that share rare words but differ in too many others aren't moved.
    assert made["pairs"].count() <= len(both(0.7))


def test_a_task_sums_a_bounded_number_of_claims_and_sources(spark, monkeypatch):
    r = random.Random(19)
    make = lambda n, least: [(i, r.sample("abcdefghij", r.randrange(least, 6))) for i in range(n)]
    claims, sources = make(6, 1), make(80, 0)
    monkeypatch.setattr(evaluation, "PAIRS", 40, raising=False)
    out = evaluation.verify_claims(spark.createDataFrame(claims, "claim_id long, words array<string>"), spark.createDataFrame(sources, "id long, words array<string>"))
    want = set()
    for c, words in claims:
        near = sorted((-len(set(words) & set(w)) / len(words), i) for i, w in sources if set(words) & set(w))[:3]
        want |= {(c, i, k + 1, -s) for k, (s, i) in enumerate(near)}
    assert {(x["claim_id"], x["id"], x["rank"], x["support"]) for x in out.collect()} == want
    # Dealt to as many parts as 6 times 80 pairs need, and summed there.
    assert ", 12), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_decree_lines_are_sorted_once_and_headings_join_nothing(spark):
    """One window carries all levels; headings are read in order by tasks that hold no document."""
    rows = spark.createDataFrame([("d", 1, 1, "1", "a", "x")], "doc string, page int, at int, chapter string, article string, clause string")
    plan = windows.carry_forward(rows, ["doc"], ["page", "at"], ["chapter", "article", "clause"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("windowspecdefinition") == 3 and plan.count("+- Window ") + plan.count("   Window ") == 1 and plan.count("Sort [") == 1
    numbers = ["1", "2", "9", "3a", "4", "x", None]
    lines = spark.createDataFrame([(d, 1, (1, i), n) for d in ("a", "b") for i, n in enumerate(numbers)], "doc string, page int, line_no struct<page:int,_at:int>, number string")
    got = chunking.plausible_articles(lines)
    assert "Join" not in _plan(got) and "InPandas" not in _plan(got)
    assert [r["number"] for r in got.orderBy("doc", "line_no").collect()] == ["1", "2", None, "3a", "4", "x", None] * 2


def test_sanctions_fold_a_text_once_and_not_for_each_term(spark):
    rows = spark.createDataFrame([(1, "d", "5", "1", "a", "Hành vi vượt đèn đỏ thì bị trừ 4 điểm", "Vượt đèn đỏ", "", None, 7)], "id long, document string, article string, clause string, point string, text string, violation string, context string, fine_min long, fine_max long")
    folds = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    assert folds(sanctions.suspensions(rows)) == 0 and folds(sanctions.amounts(rows)) == 0
    assert folds(sanctions.point_ranking(rows, 3)) == 1
    assert [(r["id"], r["points"]) for r in sanctions.point_ranking(rows, 3).collect()] == [(1, 4)]


def test_captions_are_read_once_for_both_cases(spark):
    df = spark.createDataFrame([("Xeôtô xeôtô; Lànđườngdànhcholànđườngdànhchoxemáyvàxeôtôcon Buýt bu ýt KẾTTHÚClànđườngtheo",)], "t string")
    out = df.select(cleaning.space_captions("t").alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 35  # two for each phrase were 46
    assert out.collect()[0]["t"].startswith("Xe ô tô xe ô tô; Làn đường dành cho làn đường dành cho")


def test_claims_read_their_answer_once(spark):
    r = random.Random(31)
    words = lambda most: " ".join(r.choices(["ab", "cd", "ef", "gh", "Ab", "x-y", "-"], k=r.randrange(0, most)))
    some = lambda most: r.choice([None, "", words(most), words(most), words(most)])
    rows = [(i, some(12), [(some(6), some(5)) for _ in range(r.randrange(0, 4))]) for i in range(200)]
    tokens = lambda x: re.findall(r"\w+", (x or "").lower())

    def holds(own, needle, ratio):
        a, b = tokens(own), tokens(needle)
        shared = sum((Counter(a) & Counter(b)).values())
        f1 = 1.0 if not a and not b else 2 * shared / (len(a) + len(b)) if shared else 0.0
        return "".join(b) in "".join(a) or f1 >= ratio or (shared / len(b) if b else 1.0) >= ratio

    def support(answer, claims):
        told = [(c, q) for c, q in claims if c]
        return sum(holds(answer, c, 0.55) or bool(q) and holds(answer, q, 0.45) for c, q in told) / len(told) if told else 1.0

    df = spark.createDataFrame(rows, "id long, answer string, claims array<struct<claim:string,quote:string>>")
    cited = F.transform("claims", lambda c: c["claim"])
    out = df.select("id", assets.claim_support("answer", "claims").alias("s"), evaluation.citation_accuracy("answer", cited).alias("c"))
    want = {i: (support(a, cs), sum(holds(a, c, 0.90) for c, _ in cs) / len(cs) if cs else 1.0) for i, a, cs in rows}
    assert {x["id"]: (x["s"], x["c"]) for x in out.collect()} == want
    # The words of the answer, of the claim and of the quote; a bag of words isn't made again for each of its words.
    plan = df.select(assets.claim_support("answer", "claims").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3


def test_dead_rows_of_a_stored_index_meet_texts(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame([(i, f"ab c{i % 3}" + " ab" * (i % 2)) for i in range(30)] + [(30, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "ab", 1), (2, "c1", 2)], "query_id long, token string, qtf long")
    stored_index.update(path, df, "id", "text")
    assert "LeftAnti" not in _plan(stored_index.search(spark, path, asked, 3))
    assert stored_index.remove(path, spark.createDataFrame([(1,), (4,)], "id long")) == 2
    out = stored_index.search(spark, path, asked, 3)
    fresh = index.top_k(index.bm25(df.filter("id NOT IN (1, 4)"), "id", "text", asked).withColumn("score", F.round("score", 9)), 3)
    assert sorted(map(tuple, out.select(fresh.columns).collect())) == sorted(map(tuple, fresh.collect()))
    # Words come out of their text behind the join with dead rows; hits are summed where texts were dealt to.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Aggregate [query_id") < plan.index("RepartitionByExpression") < plan.index("Generate explode") < plan.index("LeftAnti")


def test_rows_of_a_keyed_table_are_moved_once(spark, tmp_path, monkeypatch):
    path, plans, cut = f"file://{tmp_path}/table", [], buckets.tables.cut
    monkeypatch.setattr(buckets.tables, "cut", lambda df, what="cut": plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or cut(df, what))
    rows = spark.range(50).select("id", (F.col("id") % 5).alias("v"))
    assert buckets.sync(path, rows.filter("id < 30"), ["id"], buckets=4)["inserted"] == 30
    out = buckets.sync(path, rows.filter("id >= 20").withColumn("v", F.when(F.col("id") == 25, 9).otherwise(F.col("v"))), ["id"], gone=rows.filter("id IN (3, 25, 77)"))
    assert {k: out[k] for k in ("inserted", "updated", "deleted", "same")} == {"inserted": 20, "updated": 1, "deleted": 1, "same": 9}
    assert sorted(map(tuple, buckets.read(spark, path).collect())) == [(i, 9 if i == 25 else i % 5) for i in range(50) if i != 3]
    # Old and new rows meet behind one exchange, and no digest is moved or kept.
    assert [(what, plan.count("Exchange hashpartitioning")) for what, plan in plans if "Exchange" in plan] == [("met", 1)] * 2
    (held,) = {tuple(spark.read.parquet(f"{path}/data/{x}").columns) for x in buckets.tables.folders(spark, f"{path}/data")}
    assert held == ("id", "v", "_bucket", "_part")


def test_every_act_is_listed(spark):
    from codexine.plans import routes

    said = "Tước quyền sử dụng giấy phép lái xe 2 tháng."
    rows = [(i, "d", str(i), "1", "a", said, f"Điều khiển xe không đúng phần đường {i % 7}", "", 100.0 * i, 200.0 * i) for i in range(1, 301)]
    records = spark.createDataFrame(rows, "id long, document string, article string, clause string, point string, text string, violation string, context string, fine_min double, fine_max double")
    asked = spark.createDataFrame([(1, "Danh sách hành vi bị tước giấy phép lái xe"), (2, "Điều nào hay vi phạm nhất"), (3, "Toàn bộ hành vi bị tước bằng lái")], "query_id long, question string")
    got = sorted((x["query_id"], x["rank"], x["id"]) for x in routes.aggregation(records, asked).filter("kind = 'suspension'").collect())
    assert got == [(q, i, i) for q in (1, 3) for i in range(1, 301)]
    order = routes.numbered(spark.range(1000).select((F.col("id") * 7919 % 997).alias("v"), "id").repartition(7), "v", "id").orderBy("v", "id").collect()
    assert [x["rank"] for x in order] == list(range(1, 1001))


def test_every_phrase_of_a_question_counts(spark):
    words = [a + b for a in ("bal", "cor", "dim", "fen") for b in ("ta", "re", "mi", "no", "lu", "si", "ve", "po", "ga", "zu")]
    rows = spark.createDataFrame([(1, " ".join(words[:2])), (2, " ".join(words[-3:]))], "id long, text string").withColumn("document", F.lit("x"))
    asked = spark.createDataFrame([(1, " ".join(words), [])], "query_id long, question string, documents array<string>")
    got = [(x["id"], round(x["score"], 6)) for x in truth.lexical_only(rows, asked).orderBy("rank").collect()]
    assert got == [(2, 1.45), (1, 0.3)]
    assert asked.select(F.size(truth.subject_phrases("question")).alias("n")).first()["n"] == 36 + 37 + 38


def test_large_sets_that_differ_are_settled_where_they_meet(spark, monkeypatch):
    r = random.Random(23)
    words = [f"w{i}" for i in range(6000)]
    sets = [r.sample(words, r.choice([900, 1000, 1100, 2400, 2600])) for _ in range(40)]
    sets += [[*s, *[f"new{i}" for i in range(len(s) // 9)]] for s in sets[:6]]
    made, cut = {}, evaluation.cut
    monkeypatch.setattr(evaluation, "cut", lambda df, what="cut": made.setdefault(what, cut(df, what)))
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>")
    got = {(x["a"], x["b"]) for x in evaluation.near_pairs(rows, "id", "words", 0.8).collect()}
    assert got == {(i, 40 + i) for i in range(6)}
    assert made["pairs"].count() < 12


def test_words_that_bring_no_pairs_are_not_moved(spark, monkeypatch):
    from codexine.operators import prefixes

    r = random.Random(29)
    monkeypatch.setattr(prefixes, "OFTEN", 2)
    rows = spark.createDataFrame([(i, r.sample(range(400), 100)) for i in range(50)], "id long, items array<bigint>")
    known = prefixes.frequent(rows, F.col("items"))
    assert len(known[0]) and list(known[0]) == sorted(known[0])
    count = {int(k): int(n) for k, n in zip(*known, strict=True)}
    moved = {}
    for _, small, large in prefixes.sides(rows, "id", F.col("items"), known, 0.8):
        moved[_] = small.count() + large.count()
    assert 0 < sum(moved.values()) < 0.55 * 50 * 100
    order = {x["id"]: [] for x in rows.collect()}
    for x in prefixes.firsts(rows, "id", F.col("items"), known, lambda n: n).orderBy("id", "at").collect():
        order[x["id"]].append(x["item"])
    for x in rows.collect():
        assert order[x["id"]] == sorted(x["items"], key=lambda v: (count.get(v, 0), v))


def test_sequences_are_moved_by_few_of_their_items(spark, tmp_path, monkeypatch):
    r = random.Random(31)
    words = [f"w{i}" for i in range(300)]
    texts = [r.choices(words, k=r.choice([200, 300, 1200])) for _ in range(40)]
    texts += [[*t[:50], *t[55:]] for t in texts[:8]]
    made, cut, plain = {}, sequences.cut, sequences._met
    monkeypatch.setattr(sequences, "cut", lambda df, what="cut": made.setdefault(what, cut(df, what)))
    moved = []
    monkeypatch.setattr(sequences, "_met", lambda *given: moved.append(_plan(plain(*given))) or plain(*given))
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x["a"], x["b"]) for x in plans.QUERIES["sequence_pairs"](spark, str(tmp_path)).collect())
    assert got == [(i, 40 + i) for i in range(8)]
    # Runs of items aren't counted by a shuffle of all of them, and only pairs that may reach the ratio are compared.
    assert not any("Window" in p for p in moved)
    assert made["met"].count() < 12
