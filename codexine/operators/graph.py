"""Property graphs as tables of nodes (id, type, ...) and edges (source, target, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, text
from ..sources.tables import cut

#: Costs of edge types, and what going against a citation adds: fixed values.
COSTS = {
    "HAS_PENALTY": 0.20, "HAS_PROCEDURE": 0.25, "HAS_TABLE": 0.35, "HAS_FIGURE": 0.35, "HAS_SIGN": 0.35, "REPRESENTS_SIGN": 0.35,
    "HAS_CHUNK": 0.40, "HAS_POINT": 0.45, "HAS_CLAUSE": 0.50, "HAS_ARTICLE": 0.55, "PARENT_OF": 0.55, "CITES": 0.65,
}
OTHER_COST, AGAINST_CITATION = 0.90, 0.25


def edge_cost(kind: Column, reverse: Column) -> Column:
    cost = F.lit(None).cast("double")
    for name, value in COSTS.items():
        cost = F.when(kind == name, F.lit(value)).otherwise(cost)
    return F.coalesce(cost, F.lit(OTHER_COST)) + F.when(reverse & (kind == "CITES"), AGAINST_CITATION).otherwise(0.0)


def hierarchy(rows: DataFrame, levels: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a hierarchy that rows spell out: levels are pairs of a column and a node type, the highest first.

    A node's id is its type and the values down to its level, so equal names under different parents are different nodes."""
    nodes, edges = [], []
    for k, (column, kind) in enumerate(levels):
        path = [c for c, _ in levels[: k + 1]]
        full = rows.filter(F.col(column).isNotNull())
        ident = F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in path])
        nodes.append(full.select(ident.alias("id"), F.lit(kind).alias("type"), F.col(column).cast("string").alias("name")).distinct())
        if k:
            parent = F.concat_ws("|", F.lit(levels[k - 1][1]), *[F.col(c).cast("string") for c in path[:-1]])
            edges.append(full.select(parent.alias("source"), ident.alias("target"), F.lit(f"HAS_{kind.upper()}").alias("type")).distinct())
    out_nodes, out_edges = nodes[0], edges[0]
    for n in nodes[1:]:
        out_nodes = out_nodes.unionByName(n)
    for e in edges[1:]:
        out_edges = out_edges.unionByName(e)
    return out_nodes, out_edges


def reference_keys(document, article, clause, point) -> tuple[Column, Column]:
    """A node's keys with its document (of itself and of the levels above it) and without, the longest first."""
    named = lambda letter, c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.concat(F.lit(letter), F.col(c)))
    d, k, p = named("D", article), named("K", clause), named("P", point)
    levels = [F.array_compact(F.array(d, k, p)), F.array_compact(F.array(d, k)), F.array_compact(F.array(d))]
    whole = F.array(*[F.array_join(F.concat(F.array(F.coalesce(F.col(document), F.lit(""))), x), "|") for x in levels], F.coalesce(F.col(document), F.lit("")))
    bare = F.filter(F.array(*[F.array_join(x, "|") for x in levels]), lambda x: x != "")
    return F.array_distinct(whole), F.array_distinct(bare)


def resolve_targets(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Edges with target_ref in place of a target, one for each node that the reference stands for; those without any are dropped.

    The first of these that finds nodes counts: nodes of exactly that key, nodes below it, and, whatever the document, nodes
    of the longest part of it. nodes: id, document, article, clause, point. Each step is an equal join on keys. most: of each
    reference only the first so many nodes by id; all, if it isn't given."""
    whole, bare = reference_keys("document", "article", "clause", "point")
    keyed = nodes.select("id", whole.alias("_whole"), bare.alias("_bare"))
    with_document = keyed.select("id", F.posexplode("_whole").alias("_at", "_key")).select("id", "_key", F.when(F.col("_at") == 0, 0).otherwise(1).alias("_tier"))
    without = keyed.select("id", F.explode("_bare").alias("_key"))
    first = lambda df, *by: df if most is None else df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_nth") <= most).drop("_nth")
    asked = edges.filter("target IS NULL AND target_ref IS NOT NULL").select("target_ref").distinct()
    hits = asked.join(first(with_document, "_key", "_tier"), F.col("target_ref") == F.col("_key")).select("target_ref", "id", "_tier")
    parts = F.filter(F.split(F.regexp_replace("target_ref", r"^[^|]*\|?", ""), r"\|", -1), lambda x: x != "")
    shorter = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "|").alias("key")))
    suffixes = asked.filter(F.size(parts) > 0).select("target_ref", F.explode(shorter).alias("_s")).select("target_ref", F.col("_s.key").alias("_key"), (F.lit(10) - F.col("_s.n")).alias("_tier"))
    loose = suffixes.join(first(without, "_key"), "_key").select("target_ref", "id", "_tier")
    both = hits.unionByName(loose)
    least = both.groupBy("target_ref").agg(F.min("_tier").alias("_tier"))
    best = first(both.join(least, ["target_ref", "_tier"], "left_semi").select("target_ref", "id").distinct(), "target_ref").withColumnRenamed("id", "_ref")
    open_ = edges.filter("target IS NULL").join(best, "target_ref").withColumn("target", F.col("_ref")).drop("_ref")
    return edges.filter("target IS NOT NULL").unionByName(open_.select(edges.columns))


def related_assets(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = ("HAS_TABLE", "HAS_FIGURE")) -> DataFrame:
    """The tables and figures that seeds (column id) have: seed and the node's columns."""
    own = edges.filter(F.col("type").isin(*kinds)).join(seeds.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return own.select(F.col("source").alias("seed"), F.col("target").alias("id")).join(nodes, "id").select("seed", *nodes.columns)


def detail_nodes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, text) and edges of what records hold: a penalty, a procedure, and signs, which are one node for each
    code with all images and figures of it.

    records: id, text, penalty, has_procedure, figures array<struct<id, code, name, image_path>>."""
    ident = lambda kind: F.concat(F.lit(f"{kind}::"), cleaning.safe_id("id"))
    none = F.array().cast("array<string>")
    columns = lambda kind, name, body: (ident(kind).alias("id"), F.lit(kind).alias("type"), name.alias("name"), body.alias("text"), none.alias("images"), none.alias("figures"))
    penal, proc = records.filter("penalty IS NOT NULL"), records.filter("has_procedure")
    nodes = penal.select(*columns("penalty", F.lit(""), F.col("penalty"))).unionByName(proc.select(*columns("procedure", F.lit(""), F.substring("text", 1, 2000))))
    edges = penal.select(F.col("id").alias("source"), ident("penalty").alias("target"), F.lit("HAS_PENALTY").alias("type")).unionByName(proc.select(F.col("id").alias("source"), ident("procedure").alias("target"), F.lit("HAS_PROCEDURE").alias("type")))
    shown = records.select("id", F.explode("figures").alias("f")).withColumn("code", text.normalize_sign_code("f.code")).filter("code <> ''")
    sign = F.concat(F.lit("sign::"), F.col("code"))
    signs = shown.groupBy("code").agg(F.max_by("f.name", F.struct("id", "f.id")).alias("name"), F.array_sort(F.array_compact(F.collect_set("f.image_path"))).alias("images"), F.array_sort(F.collect_set("f.id")).alias("figures"))
    nodes = nodes.unionByName(signs.select(sign.alias("id"), F.lit("sign").alias("type"), F.coalesce("name", F.lit("")).alias("name"), text.sign_group("code").alias("text"), "images", "figures"))
    has = shown.select(F.col("id").alias("source"), sign.alias("target"), F.lit("HAS_SIGN").alias("type")).distinct()
    shows = shown.select(F.col("f.id").alias("source"), sign.alias("target"), F.lit("REPRESENTS_SIGN").alias("type")).distinct()
    return nodes, edges.unionByName(has).unionByName(shows)


def cited_documents(x, at: Column, own: Column, aliases) -> Column:
    """The documents that stand near a citation at a place of a text, or the text's own if none does."""
    near = text.fold(F.substring(text.col(x), F.greatest(at - 119, F.lit(1)), F.lit(380)))
    found = F.array_compact(F.array(*[F.when(text.contains_any(near, terms), F.lit(name)) for name, terms in aliases]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(own))


def merge(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graphs as one: of equal node ids the last graph's, and distinct edges."""
    rows = None
    for k, n in enumerate(nodes):
        part = n.withColumn("_at", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, True)
    last = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))).filter("_nth = 1").drop("_nth", "_at")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e, True)
    return last, out.dropDuplicates()


def neighbours(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Both directions as a, b, cost."""
    kept = edges.filter(F.col("type").isin(*kinds)) if kinds else edges
    there = kept.select(F.col("source").alias("a"), F.col("target").alias("b"), edge_cost(F.col("type"), F.lit(False)).alias("cost"))
    return there.unionByName(kept.select(F.col("target").alias("a"), F.col("source").alias("b"), edge_cost(F.col("type"), F.lit(True)).alias("cost")))


def expand(edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, weighted: bool = True, most: int | None = None) -> DataFrame:
    """Nodes within depth hops of the seeds (column id), by any direction: id, hops, cost of the cheapest path of at most so
    many hops. Exact for the limit: each hop relaxes the cheapest cost of every node reached in one hop more. most: keep the
    cheapest so many nodes, ties by hops and id."""
    around = neighbours(edges, kinds)
    reached = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), F.lit(0.0).alias("cost")))
    front = reached
    for hop in range(1, max(0, depth) + 1):
        step = front.join(around, front["id"] == around["a"]).groupBy(F.col("b").alias("id")).agg(F.min(front["cost"] + (around["cost"] if weighted else F.lit(1.0))).alias("cost"))
        step = step.select("id", F.lit(hop).alias("hops"), "cost")
        better = step.join(reached.select("id", F.col("cost").alias("old")), "id", "left").filter("old is null or cost < old").drop("old")
        front = cut(better)
        if not front.take(1):
            break
        reached = cut(reached.unionByName(front).groupBy("id").agg(F.min(F.struct("cost", "hops")).alias("_m")).select("id", "_m.hops", "_m.cost"))
    return reached.orderBy("cost", "hops", "id").limit(most) if most else reached


def paths(edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """id, hops, cost, path, kinds of the nodes within depth hops of the seeds (column id): the cheapest path of at most so many hops,
    from its seed on, and what joins its nodes (`-TYPE>`, or `<TYPE-` against an edge). Ties go by fewer hops, then by the nodes.

    Each hop takes the paths that got better one node on; a path never comes back to a node of its own. So rows carry depth
    nodes at most, and a node one path at a time."""
    kept = edges.filter(F.col("type").isin(*kinds)) if kinds else edges
    around = kept.select(F.col("source").alias("a"), F.col("target").alias("b"), edge_cost(F.col("type"), F.lit(False)).alias("step"), F.concat(F.lit("-"), "type", F.lit(">")).alias("by"))
    around = around.unionByName(kept.select(F.col("target").alias("a"), F.col("source").alias("b"), edge_cost(F.col("type"), F.lit(True)).alias("step"), F.concat(F.lit("<"), "type", F.lit("-")).alias("by")))
    around = cut(around.groupBy("a", "b").agg(F.min(F.struct("step", "by")).alias("s")).select("a", "b", "s.step", "s.by"), "around")
    reached = seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), F.lit(0.0).alias("cost"), F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    reached = front = cut(reached, "reached")
    # Sums are rounded, so that equal costs tie whatever the order that they are summed in.
    better = F.min(F.struct("cost", "hops", "path", "kinds")).alias("m")
    for hop in range(1, max(0, depth) + 1):
        step = front.join(around, front["id"] == around["a"]).filter(~F.array_contains("path", F.col("b")))
        step = step.select(F.col("b").alias("id"), F.lit(hop).alias("hops"), F.round(F.col("cost") + F.col("step"), 9).alias("cost"), F.array_append("path", F.col("b")).alias("path"), F.array_append("kinds", F.col("by")).alias("kinds"))
        step = step.groupBy("id").agg(better).select("id", "m.hops", "m.cost", "m.path", "m.kinds")
        old = reached.select("id", F.struct("cost", "hops", "path", "kinds").alias("old"))
        front = cut(step.join(old, "id", "left").filter(F.col("old").isNull() | (F.struct("cost", "hops", "path", "kinds") < F.col("old"))).drop("old"), "front")
        if not front.take(1):
            break
        reached = cut(reached.unionByName(front).groupBy("id").agg(better).select("id", "m.hops", "m.cost", "m.path", "m.kinds"), "reached")
    return reached


def expand_hits(hits: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None, per_query: int | None = None) -> DataFrame:
    """query_id, id, score of the nodes around each query's hits (query_id, id, score), which aren't hits themselves: the cheapest
    path of at most so many hops from any hit, and a score from the best hit's. per_query: each query keeps its cheapest so many;
    all, if it isn't given."""
    around = cut(neighbours(edges, kinds), "around")
    reached = cut(hits.select("query_id", "id", F.lit(0.0).alias("cost")).distinct(), "reached")
    front = reached
    for _ in range(depth):
        step = front.join(around, front["id"] == around["a"]).groupBy("query_id", F.col("b").alias("id")).agg(F.min(front["cost"] + around["cost"]).alias("cost"))
        better = step.join(reached.select("query_id", "id", F.col("cost").alias("old")), ["query_id", "id"], "left").filter("old IS NULL OR cost < old").drop("old")
        front = cut(better, "front")
        reached = cut(reached.unionByName(front).groupBy("query_id", "id").agg(F.min("cost").alias("cost")), "reached")
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    new = reached.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    if per_query is not None:
        new = new.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "id"))).filter(F.col("_nth") <= per_query)
    score = F.greatest(F.lit(0.9), F.least(F.col("_best") - 0.22 * F.col("cost"), F.greatest(F.lit(1.8), 0.72 * F.col("_best"))))
    return new.join(best, "query_id").select("query_id", "id", score.alias("score"))


def graph_scores(seed_best: float, cost: Column) -> Column:
    """Scores of nodes that an expansion found, from the best seed's."""
    return F.greatest(F.lit(0.9), F.least(F.lit(seed_best) - 0.22 * cost, F.lit(max(1.8, 0.72 * seed_best))))


def induced(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct edges whose two ends are among the nodes (column id)."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").dropDuplicates(["source", "target", "type"])
    return out.orderBy("source", "target", "type").limit(most) if most else out


def same_reference(nodes: DataFrame, seeds: DataFrame, keys: list[str], costs: list[float], per_seed: int) -> DataFrame:
    """Siblings of seeds: nodes that share the leading keys, at the cost of the longest match. keys: the highest first;
    costs[n - 1] is that of n shared keys.

    Of the nodes that share keys, the first by id are enough: one more than asked for, as a seed isn't its own sibling."""
    found = None
    for n in range(len(keys), 0, -1):
        nth = F.row_number().over(Window.partitionBy(*keys[:n]).orderBy("id"))
        first = nodes.filter(F.col("id").isNotNull()).select("id", *keys[:n]).distinct().withColumn("_nth", nth).filter(F.col("_nth") <= per_seed + 1).drop("_nth")
        hit = seeds.select(F.col("id").alias("seed"), *keys[:n]).join(first, keys[:n]).filter("id <> seed").select("seed", "id", F.lit(costs[n - 1]).alias("cost"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("seed", "id").agg(F.min("cost").alias("cost"))
    return best.withColumn("_nth", F.row_number().over(Window.partitionBy("seed").orderBy("cost", "id"))).filter(F.col("_nth") <= per_seed).drop("_nth")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), type, n."""
    count = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))
