"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles of five words (lower case, white space between words); a document of fewer words
is one shingle. Documents of equal sets are one text. Texts are split recursively: in each run a text goes to the
buckets of those of its shingles that a hash selects, about SPREAD of them, so two texts that share 0.8 of their
shingles share buckets about SPREAD times, and unrelated ones don't. Buckets of at most SMALL texts are compared by
brute force over sketches. In a larger one, texts near one text (the pivot) are tied to it. If few aren't, those are
compared to all that they may be linked to; otherwise both are split on, by a second selected shingle and then by values
of their sketches, until buckets are small; what is large after LEVELS splits is compared in blocks. RUNS runs bring the expected recall to RECALL. That gives groups that hold all links;
within each, every pair's Jaccard similarity is computed exactly, block against block, and counted once. Pairs aren't
written out: a text keeps its number of links, and a group its spanning trees.

Defined cases: documents without words (null, empty) have no links, and a class each; equal texts are linked; equal rows
are rows each; rows of a null id are linked and counted; the class is the least doc_id of all that are tied by links,
directly or not; a long text is one set, by one task; extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, slices, table
from .components import components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
SPREAD = 2.0
SMALL, BLOCK = 96, 512
#: Levels at which large buckets are split.
LEVELS = 4
#: Shingles in a block of the exact comparison, on average; and cells of the dense matrix that counts shared ones.
WEIGHT, DENSE = 1 << 18, 1 << 22
BINS = 64
#: Words whose hashes a task keeps.
_CACHE = 100_000


def _runs(levels: int) -> int:
    """Runs until a pair at the similarity is missed with a probability of 1 - RECALL, in buckets of the last level.

    Such a pair shares SPREAD selected shingles a level on average, so a run of one level misses it with exp(-SPREAD)."""
    miss = 0.0
    for _ in range(levels):
        miss = math.exp(-SPREAD * (1 - miss))
    return math.ceil(math.log(1 - RECALL) / math.log(miss))


RUNS = _runs(LEVELS + 1)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingles as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def __call__(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        tokens = text.lower().split()
        for w in tokens:
            h = cache.get(w)
            if h is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        codes = np.array(out, np.uint64)
        n = min(self.words, len(codes))
        if not n:
            return codes
        total = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + _mix(codes[k : k + len(total)], k + 1)
        return np.unique(_mix(total, n))


def paths(shingles: np.ndarray, runs: int = RUNS, spread: float = SPREAD) -> list[dict]:
    """The selected shingles of each run as bucket keys, each with the keys of its own split."""
    out = []
    limit = np.uint64(min(0xFFFFFFFFFFFFFFFF, int(spread / (SIMILARITY * len(shingles)) * 2**64)))
    for run in range(runs):
        keys = _mix(shingles[_mix(shingles, 100 + run) <= limit], 200 + run)
        for key in keys.tolist():
            inner = shingles[_mix(shingles ^ np.uint64(key), 300 + run) <= limit]
            out.append({"key": key - 2**63, "next": (_mix(inner ^ np.uint64(key), 400).astype(np.int64)).tolist()})
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Eight bits of the least hash in each of BINS ranges of hashes, 0 where there is none."""
    at = np.searchsorted(shingles, (np.arange(BINS + 1, dtype=np.uint64)[:-1] << np.uint64(58)))
    at = np.append(at, len(shingles))
    some = at[1:] > at[:-1]
    out = np.zeros(BINS, np.uint8)
    out[some] = ((_mix(shingles[at[:-1][some]], 7) >> np.uint64(20)) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarities of sketches a x b, and their standard errors at the similarity."""
    shared = np.stack([((x == b) & (x > 0)).sum(1) for x in a])
    filled = np.stack([((x > 0) | (b > 0)).sum(1) for x in a])
    filled = np.maximum(filled, 1)
    return shared / filled, np.sqrt(SIMILARITY * (1 - SIMILARITY) / filled)


def _keys():
    """Two hashes of text: together they tell texts apart at any size, as one of 64 bits wouldn't."""
    return F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit("more"), "text").alias("text_more")


def texts(documents: DataFrame) -> DataFrame:
    """doc_id, text_key and text_more (hashes of the text), node (of its set; null without words), n, paths, sketch of every document."""
    names = ["doc_id", "text_key", "text_more", "node", "n", "paths", "sketch"]
    path = pa.list_(pa.struct([("key", pa.int64()), ("next", pa.list_(pa.int64()))]))

    def run(batches):
        shingler = Shingler()
        for part in slices(batches):
            rows = [], [], [], []
            for text in part.column("text").to_pylist():
                s = shingler(text)
                for to, x in zip(rows, (xxhash.xxh3_128_digest(s.tobytes()), len(s), paths(s), sketch(s)) if len(s) else (None, 0, [], None), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], path), pa.array(rows[3], pa.binary())], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", blank("text").alias("text")).select("doc_id", *_keys(), "text")
    return arrow(rows, run, f"doc_id {kind}, text_key long, text_more long, node binary, n long, paths array<struct<key:long,next:array<long>>>, sketch binary")


def streamed(batches, key: str):
    """(key, rows as a table) of partitions that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        ends = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist() if len(keys) else []
        if held and len(keys) and held[0].column(key)[0].as_py() != keys[0]:
            ends = [0, *ends]
        at = 0
        for end in ends:
            whole = pa.Table.from_batches([*held, batch.slice(at, end - at)])
            held, at = [], end
            yield whole.column(key)[0].as_py(), whole
        if at < len(keys):
            held.append(batch.slice(at))
    if held:
        yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)


def _ties(rows: pa.Table) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the rows' texts that may be similar by their sketches; in a cell of two blocks, only across."""
    nodes = rows.column("node").to_pylist()
    sides = rows.column("side").to_numpy()
    marks = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    two = rows.column("two")[0].as_py()
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if two else (np.arange(len(nodes)),) * 2
    if not len(left) or not len(right):
        return []
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, len(left), 64):
        own = left[at : at + 64]
        est, error = alike(marks[own], marks[right])
        for i, j in np.argwhere(est >= SIMILARITY - 4 * error - 0.02):
            a, b = find(int(own[i])), find(int(right[j]))
            if a != b:
                root[a] = b
                out.append((nodes[own[i]], nodes[right[j]]))
    return out


def _bucket_ties(rows: DataFrame) -> DataFrame:
    """cell, two, side, node, sketch to edges a, b."""

    def run(batches):
        for part in streamed(batches, "cell"):
            if part[1].num_rows > 1:
                edges = _ties(part[1])
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["a", "b"])

    return arrow(rows.repartition("cell").sortWithinPartitions("cell"), run, "a binary, b binary")


def _blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Deals a group's nodes to cells, one for every two of its blocks; side tells the blocks of a cell apart.

    two: the cell is of two blocks, also where one of them is empty."""
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda other: F.struct(F.least(F.col("_own"), other).alias("i"), F.greatest(F.col("_own"), other).alias("j")))
    rows = rows.withColumn("_own", own).withColumn("_cell", F.explode(cells))
    return rows.withColumn("side", F.when(F.col("_cell.i") == F.col("_cell.j"), 0).otherwise((F.col("_own") == F.col("_cell.j")).cast("int"))).withColumn("two", F.col("_cell.i") != F.col("_cell.j")).withColumn("cell", F.xxhash64(group, "_cell")).drop("_own", "_cell")


def _pivoted(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large buckets: edges of texts near the pivot to it, cells to be compared, and the rows that go on.

    Texts within 0.8 are tied, and two tied texts need no other edge. So only links to texts that aren't tied are still to be
    found: those texts go on, and of the tied ones those that may be linked to one of them. Two linked texts differ by 0.2 at
    most, so a tied text stays behind if it is nearer to the pivot than the nearest untied one by 0.3 and an error of the
    sketches, and all of a bucket without untied texts do. At most SMALL untied texts are compared to each other and to the tied
    ones, a block at a time; a bucket with more is split on."""
    pivot = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node", "sketch")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("mark"))

    def run(batches):
        for batch in batches:
            marks = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "mark")]
            shared = ((marks[0] == marks[1]) & (marks[0] > 0)).sum(1)
            filled = np.maximum(((marks[0] > 0) | (marks[1] > 0)).sum(1), 1)
            far = 1 - shared / filled
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "sketch", "pivot")), pa.array(far), pa.array(far + 0.3 + 0.8 / np.sqrt(filled))], ["key", "node", "sketch", "pivot", "far", "reach"])

    # Dealt by node first, as the rows of one bucket may lie in few files.
    far = cut(arrow(rows.select("key", "node", "sketch").repartition("node").join(cut(pivot, "pivot"), "key"), run, "key long, node binary, sketch binary, pivot binary, far double, reach double"), "pivots")
    sizes = cut(far.groupBy("key").agg(F.min(F.when(F.col("far") > 0.8, F.col("far"))).alias("least"), F.count(F.when(F.col("far") > 0.8, 1)).alias("untied"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("untied > 0"), "untied")
    on = far.join(sizes, "key").filter("far > 0.8 or reach > least")
    few = on.filter(F.col("untied") <= SMALL)
    blocks = F.when(F.col("far") > 0.8, F.sequence(F.lit(-1), (F.col("blocks") - 1).cast("int"))).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    dealt = few.withColumn("block", F.explode(blocks))  # -1: the untied ones among themselves
    cells = dealt.select(F.xxhash64("key", "block").alias("cell"), (F.col("block") >= 0).alias("two"), (F.col("far") <= 0.8).cast("int").alias("side"), "node", "sketch")
    return far.filter("far <= 0.8 and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), cells, on.filter(F.col("untied") > SMALL).select("key", "node", "sketch")


def _split(rows: DataFrame) -> DataFrame:
    """key, node, sketch of large buckets to the buckets of the next level: a text goes to those of the values of its
    sketch that a hash of the bucket selects, about SPREAD / SIMILARITY of them. Texts that share a passage only agree in
    few values, so they part; linked ones agree in most."""

    def run(batches):
        for part in slices(batches, 2048):
            keys = part.column("key").to_numpy().astype(np.uint64)
            marks = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            chance = np.minimum(1.0, SPREAD / (SIMILARITY * np.maximum((marks > 0).sum(1), 1)))
            bins = _mix(np.arange(BINS, dtype=np.uint64), 500)
            drawn = _mix(keys[:, None] ^ bins[None], 501).astype(np.float64) / 2.0**64
            row, at = np.nonzero((drawn <= chance[:, None]) & (marks > 0))
            key = _mix(keys[row] ^ _mix(at.astype(np.uint64) * np.uint64(256) + marks[row, at], 502), 503).view(np.int64)
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key), taken.column("node"), taken.column("sketch")], ["key", "node", "sketch"])

    return arrow(rows, run, "key long, node binary, sketch binary")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges a, b that tie together all texts that may be linked. reps: node, paths, sketch.

    The first two levels split by shingles, the others by values of sketches. Only large buckets are split, so there are
    as many levels as the data need; what is large after LEVELS is compared in blocks."""
    edges = []
    rows = reps.select("node", "sketch", F.explode("paths").alias("p")).select(F.col("p.key").alias("key"), "node", "sketch")
    for level in range(LEVELS + 1):
        rows = cut(rows, "buckets")
        # As a table of its own, so that Spark may split the join where one bucket holds many texts.
        sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        sized = cut(rows.join(sizes, "key"), "sized")
        edges.append(_bucket_ties(sized.filter(F.col("size") <= SMALL).select(F.col("key").alias("cell"), F.lit(False).alias("two"), F.lit(0).alias("side"), "node", "sketch")))
        large = sized.filter(F.col("size") > SMALL)
        if not large.take(1):
            break
        if level == LEVELS:
            edges.append(_bucket_ties(_blocks(large.withColumn("size", F.ceil(F.col("size") / BLOCK)), "key", F.col("size")).select("cell", "two", "side", "node", "sketch")))
            break
        near, cells, rows = _pivoted(large)
        edges += [near, _bucket_ties(cells)]
        if level == 0:
            split = rows.join(reps.select("node", "paths"), "node")
            rows = split.select(F.explode(F.flatten(F.transform(F.filter("paths", lambda p: p["key"] == F.col("key")), lambda p: p["next"]))).alias("key"), "node", "sketch")
        else:
            rows = _split(rows)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def links_of(sets: list[np.ndarray], copies: np.ndarray, sides: np.ndarray, two: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The number of links of each set, with copies counted, and a spanning forest of them; in a cell of two blocks, only across."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width = max(1, DENSE // n)
    for at in range(0, (int(column[-1]) + 1) if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        common += part @ part.T
    linked = 9 * common >= 4 * (sizes[:, None] + sizes[None])  # a Jaccard similarity of 0.8
    np.fill_diagonal(linked, False)
    if two:
        linked &= sides[:, None] != sides[None]
    links = linked @ copies
    root = np.arange(n)
    forest = []
    for start in range(n):
        if root[start] == start and linked[start].any():
            # Breadth first from start; reached nodes are done.
            todo, reached = [start], np.zeros(n, bool)
            reached[start] = True
            while todo:
                new = linked[todo].any(0) & ~reached
                reached |= new
                todo = np.flatnonzero(new).tolist()
            members = np.flatnonzero(reached)
            root[members] = n
            forest += [(start, int(m)) for m in members if m != start]
    return links, forest


def _verified(cells: DataFrame) -> DataFrame:
    """cell, two, side, node, copies, shingles to node, other (of a spanning forest, or null), links."""

    def run(batches):
        for _, rows in streamed(batches, "cell"):
            nodes = rows.column("node").to_pylist()
            sides, copies = rows.column("side").to_numpy(), rows.column("copies").to_numpy()
            first: dict[bytes, int] = {}
            for k, x in enumerate(nodes):
                first.setdefault(x, k)
            once = list(first.values())
            two = rows.column("two")[0].as_py()
            if len(once) < 2 or two and len(set(sides.tolist())) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            links, forest = links_of([sets[k] for k in once], copies[once], sides[once], two)
            nodes = [nodes[k] for k in once]
            hit = np.flatnonzero(links)
            out = [(nodes[k], None, int(links[k])) for k in hit] + [(nodes[a], nodes[b], 0) for a, b in forest]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], ["node", "other", "links"])

    return arrow(cells.repartition("cell").sortWithinPartitions("cell"), run, "node binary, other binary, links long")


def join(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, n_links of every document, and is_first: whether the row's id and text are those of its
    class's first row, by id (null ids last) and hash of the text. Equal rows are first together."""
    rows = cut(texts(documents), "texts")
    named = rows.filter("node is not null")
    reps = named.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "text_more")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    reps = cut(reps, "reps")
    groups = cut(components(candidates(reps)), "groups")
    active = cut(groups.join(reps.select("node", "rep", "copies", "n"), "node"), "active")
    sizes = active.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / WEIGHT)).alias("blocks"))
    active = cut(active.join(cut(sizes, "sizes"), "root"), "active")
    # The sets are made again from one text each, as to keep those of all would take more room. Equal texts are put together
    # before they are moved.
    wanted = active.select("node", F.col("rep.text_key").alias("text_key"), F.col("rep.text_more").alias("text_more"), "root", "copies", "blocks").hint("shuffle_hash")
    source = documents.select(blank("text").alias("text")).select(*_keys(), "text").groupBy("text_key", "text_more").agg(F.any_value("text").alias("text"))
    found = source.join(wanted, ["text_key", "text_more"]).select("node", "root", "copies", "blocks", "text")

    def shingled(batches):
        shingler = Shingler()
        for part in slices(batches):
            sets = [shingler(t) for t in part.column("text").to_pylist()]
            own = [xxhash.xxh3_128_digest(s.tobytes()) == x for s, x in zip(sets, part.column("node").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "root", "copies", "blocks")), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "copies", "blocks", "shingles"])
            yield out.filter(pa.array(own))

    sets = arrow(found, shingled, "node binary, root binary, copies long, blocks long, shingles binary")
    results = cut(_verified(_blocks(sets, "root", F.col("blocks")).select("cell", "two", "side", "node", "copies", "shingles")), "links")
    links = results.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(results.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = reps.select("node", "copies", "rep").join(links, "node", "left").join(tied, "node", "left")
    nodes = cut(nodes.withColumn("root", F.coalesce("root", "node")), "nodes")
    classes = nodes.groupBy("root").agg(F.min("rep").alias("first"))
    nodes = nodes.join(cut(classes, "classes"), "root").select("node", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    nodes = cut(nodes, "nodes")
    out = rows.select("doc_id", "text_key", "node").join(nodes, "node", "left")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("node").isNull() | own).alias("is_first"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("text_key", "is_first")
