"""SimHash near-dedup by bit-sliced comparison.

A document's fingerprint has 64 bits: bit k is set if it is set in more than half of the hashes of its three-word
shingles. Fingerprints that differ in at most RADIUS bits are linked, and documents of linked fingerprints are one
component. Equal fingerprints are one. Those that may be linked meet in buckets: of BLOCKS blocks of bits, RADIUS can
differ, so two linked ones agree in the other three, and each goes to a bucket for every three blocks. Where many share
a bucket, they are dealt on by quarters of the remaining bits, of which linked ones share one; what is still large is
compared block against block. So each link is found, and none is listed: a bucket gives a spanning forest.

Buckets are compared bit-sliced. The fingerprints of many buckets stand in a row, one bit plane for each bit. A plane and
the same plane shifted by d places tell whether that bit differs for all pairs of places d apart; carry-save counters add
that up for 64 pairs in a word, and a word is abandoned once all of its pairs exceed the radius.

Defined cases: a text without words (null, empty) has the fingerprint zero, which is linked like any other; one of fewer
words than a shingle is one shingle; equal rows are rows each; rows of a null id are linked, and a component of such rows
alone has a null id; a long text's hashes are counted in parts; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, cut, slices, table
from .components import components
from .ngram_join import streamed

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Blocks of bits; buckets share BLOCKS - RADIUS of them. Parts that the bits of the others are cut to in large buckets.
BLOCKS, PARTS = 6, 4
#: Fingerprints of a bucket that are compared without a further split, and of those that are compared at once.
SMALL, STRIP = 4096, 1 << 16
#: Hashes that are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """Only A-Z become lower case, and words end at ASCII white space: as bytes do it."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    ends = (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    total = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, COUNTED):
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + COUNTED], ends[at : at + COUNTED], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and code of every document: the fingerprint as a signed long."""

    def run(batches):
        for part in slices(batches):
            codes = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, code long")


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For every choice of blocks that linked fingerprints may agree in: its bits, and those of each part of the rest."""
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        own = {k for c in chosen for k in range(ends[c], ends[c + 1])}
        rest = [k for k in range(BITS) if k not in own]
        parts = [rest[len(rest) * p // PARTS : len(rest) * (p + 1) // PARTS] for p in range(PARTS)]
        out.append((sum(1 << k for k in own), [sum(1 << k for k in p) for p in parts]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(codes: np.ndarray) -> np.ndarray:
    """Bit planes, 64 codes to a word, with a word of zeros behind."""
    n = -(-len(codes) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(codes)] = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return np.pad(words, ((0, 0), (0, 2)))


def within(sliced: np.ndarray, valid: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Of the pairs (i, i + shift) that valid (a word for 64 of them) names, those that differ in at most radius bits, as words."""
    counters = max(1, radius.bit_length())
    ahead, bit = divmod(shift, 64)
    out = np.zeros_like(valid)
    at = np.flatnonzero(valid)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Begun so high that a counter overflows at radius + 1.
    bias = (1 << counters) - 1 - radius
    count = [np.full(len(at), full if bias >> k & 1 else 0, np.uint64) for k in range(counters)]
    over = ~valid[at]
    for first in range(0, BITS, 8):
        own = sliced[first : first + 8]
        inside = at + ahead < own.shape[1] - 1
        where = np.where(inside, at + ahead, own.shape[1] - 2)
        moved = own[:, where] >> np.uint64(bit)
        if bit:
            moved |= own[:, where + 1] << np.uint64(64 - bit)
        for differs in own[:, at] ^ moved:
            for k in range(counters):
                carry = count[k] & differs
                count[k] ^= differs
                differs = carry
            over |= differs
        near = over != full
        if not near.all():  # words whose pairs all exceed the radius go
            at, over, count = at[near], over[near], [c[near] for c in count]
            if not len(at):
                return out
    out[at] = ~over
    return out


def forest(bucket: np.ndarray, codes: np.ndarray, sides: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places of linked codes that tie each bucket's linked ones together. Equal buckets stand together; sides: 0 or 1 where only
    codes of different sides are compared, or 2."""
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)))
    order = np.argsort(np.repeat(-sizes, sizes), kind="stable")  # the largest first, so what has d neighbours stands before what hasn't
    bucket, codes, sides, size = bucket[order], codes[order], sides[order], np.repeat(sizes, sizes)[order]
    sliced, root, out = planes(codes), np.arange(len(codes)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for shift in range(1, int(sizes.max()) if len(sizes) else 0):
        n = int(np.searchsorted(-size, -shift, "left")) - shift  # places in buckets of more than shift codes
        if n <= 0:
            break
        valid = (bucket[:n] == bucket[shift : n + shift]) & (root[:n] != root[shift : n + shift])
        valid &= (sides[:n] == 2) | (sides[:n] != sides[shift : n + shift])
        if not valid.any():
            continue
        words = np.packbits(np.pad(valid, (0, -n % 64)), bitorder="little").view("<u8")
        near = within(sliced[:, : -(-(n + shift) // 64) + 2], words, shift, radius)
        hits = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        for i in hits.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[i + shift])))
        if len(hits):
            while not np.array_equal(above := root[root], root):
                root = above
    return out


def _compared(rows: DataFrame) -> DataFrame:
    """cell, side, code to edges a, b of a spanning forest of each cell."""

    def strips(batches):
        held, n = [], 0
        for _, part in streamed(batches, "cell"):
            if part.num_rows > 1:
                held.append(part)
                n += part.num_rows
                if n >= STRIP:
                    yield pa.concat_tables(held)
                    held, n = [], 0
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        for part in strips(batches):
            codes = part.column("code").to_numpy()
            edges = np.array(forest(part.column("cell").to_numpy(), codes, part.column("side").to_numpy()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(codes[edges[:, 0]]), pa.array(codes[edges[:, 1]])], ["a", "b"])

    return arrow(rows.repartition("cell").sortWithinPartitions("cell"), run, "a long, b long")


def _large(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """key, code to those in buckets of 2 to small codes, as cells, and those in larger ones, with the bucket's size."""
    # As a table of its own, so that Spark may split the join where one bucket holds many.
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    sized = rows.join(sizes, "key")
    few = sized.filter(F.col("size") <= small).select(F.col("key").alias("cell"), F.lit(2).alias("side"), "code")
    if not sizes.filter(F.col("size") > small).take(1):
        return few, None
    return few, cut(sized.filter(F.col("size") > small), "large")


def links(codes: DataFrame, small: int = SMALL) -> DataFrame:
    """code (distinct) to edges a, b: every two codes within RADIUS bits are tied, directly or over others."""
    chosen = masks()
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), F.col("code").bitwiseAND(_signed(own))).alias("key")) for k, (own, _) in enumerate(chosen)]))
    few, large = _large(codes.select("code", keys.alias("k")).select("k.key", "k.mask", "code"), small)
    cells = [few]
    if large is not None:
        rest = F.array(*[F.array(*[F.lit(_signed(p)) for p in parts]) for _, parts in chosen])
        parts = F.transform(F.get(rest, F.col("mask")), lambda m, k: F.xxhash64("key", k, F.col("code").bitwiseAND(m)))
        few, large = _large(large.select(F.explode(parts).alias("key"), "code"), small)
        cells.append(few)
    if large is not None:
        own, n = F.pmod(F.xxhash64("code"), F.col("n")).cast("int"), F.ceil(F.col("size") / small).cast("int")
        dealt = large.withColumn("n", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        cells.append(dealt.select(cell.alias("cell"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "code"))
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more)
    return _compared(out)


def near(documents: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    rows = cut(fingerprints(documents), "fingerprints")
    codes = cut(rows.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    tied = components(links(codes.select("code"), small))
    codes = codes.join(tied, codes["code"] == tied["node"], "left").select("code", F.coalesce("root", "code").alias("root"), "first")
    codes = cut(codes, "roots")
    least = codes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(codes.join(least, "root").select("code", "component_id"), "named")
    return rows.join(named, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "documents"))
