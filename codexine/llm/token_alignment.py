"""Cross-tokenizer alignment by union-find over overlapping tokens.

A text with a space before it is encoded by a byte-level vocabulary (A) and, without that space, by a piece vocabulary
(B, which adds it). Tokens of A and B whose byte ranges overlap are joined by union-find; the components are exactly the
minimal groups, cut where both have a token's end. The members of a component that end together are its links. A pair of
ids counts as often as the whole corpus links it; counts are summed by pair in Spark, and meet the documents again.

Neither vocabulary has a token that goes on over a space behind another character, so a text is cut there into chunks,
which are encoded and aligned by themselves, many at once, and kept in a bounded store.

Defined cases: a null or empty text has no tokens; so has a text whose joined A or B bytes differ from the space and the
text (it holds U+2581, say): its columns are zeros, its groups the empty text. The strings of special tokens are plain
text. Equal rows, and rows of null ids, are rows each, and count each. A long chunk is encoded whole. An empty table gives
no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .common import arrow, blank, cut, join_checked, slices, table
from .packing import LONG, tokenizer

#: Bits of a pair's key that hold the id of B.
SHIFT = 20
#: Chunks that a task keeps, and links and characters of groups that they have together.
KEPT, KEPT_LINKS, KEPT_CHARS = 200_000, 2_000_000, 50_000_000
#: Pairs of ids that may be broadcast after they were counted.
PAIRS = 1_000_000
#: A space behind a character that isn't white space.
CUT = re.compile(r"(?<=\S) ")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component: the larger root of every edge is hooked to the smaller one, and paths are
    halved, until no edge has two roots."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
    return root


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, numbered in the order of the text. Both cover the same bytes."""
    ends = np.union1d(ends_a, ends_b)
    starts = np.concatenate([[0], ends[:-1]])
    # Between two ends there is one token of each: those overlap.
    root = components(len(ends_a) + len(ends_b), np.searchsorted(ends_a, starts, "right"), len(ends_a) + np.searchsorted(ends_b, starts, "right"))
    least, of_a = np.unique(root[: len(ends_a)], return_inverse=True)
    return of_a, np.searchsorted(least, root[len(ends_a) :])


class Aligner:
    """Encodes and aligns chunks: texts with a space before each, which isn't written."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.fast, self.slow = tokenizer(path_a), encoder(path_a)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(k) for k in range(size)]
        self.bytes_a = self.slow.transducer.bytes
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.sp.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.space = self.sp.piece_to_id("▁")
        # What stands behind an id in the text of groups; the last of B in a chunk has nothing behind it.
        self.words = [f"{k}{end}" for end in ",|" for k in range(len(self.bytes_a))] + [f"{k}{end}" for end in (",", ";", "") for k in range(size)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n = [array("q") for _ in range(4)]  # tokens of A, of B, groups; 1 if the bytes agree
        self.keys, self.ends, self.groups, self.chars = array("q"), array("q", [0]), [], 0

    def encode(self, chunks: list[str]) -> tuple[list, list]:
        a = [np.frombuffer(b"".join(self.slow.plain(f" {x}")), "<u4").tolist() if len(x) > LONG else self.fast.encode_ordinary(f" {x}") for x in chunks]
        # Behind a space that ends the text nothing is left to add a space to.
        b = [ids if x else [self.space] for x, ids in zip(chunks, self.sp.encode(chunks, num_threads=1), strict=True)]
        return a, b

    def add(self, chunks: list[str]) -> None:
        """Aligns chunks and adds them to the store."""
        a, b = self.encode(chunks)
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        raw = [f" {x}".encode() for x in chunks]
        ok = np.array([b"".join([self.bytes_a[k] for k in x]) == t == b"".join([self.bytes_b[k] for k in y]) for x, y, t in zip(a, b, raw, strict=True)])
        n_a, n_b = n_a * ok, n_b * ok
        ids_a, ids_b = (np.array([k for x, own in zip(ids, ok, strict=True) if own for k in x], np.int64) for ids in (a, b))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        of_a, of_b = groups_of(ends_a, ends_b)
        chunk_a, chunk_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
        # Of a component's members, those that end together are linked.
        _, i, j = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        n_links = np.bincount(chunk_a[i], minlength=len(chunks))
        n_groups = np.bincount(chunk_a[last_a], minlength=len(chunks))
        total = (of_a[-1] + 1) if len(of_a) else 0
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=total))]) for x in (of_a, of_b))
        final = last_b & np.append(chunk_b[1:] != chunk_b[:-1], True)[: len(chunk_b)]
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        word[np.arange(len(ids_a)) + before_b[of_a]] = ids_a + last_a * len(self.bytes_a)
        word[np.arange(len(ids_b)) + before_a[of_b + 1]] = 2 * len(self.bytes_a) + ids_b + (last_b.astype(np.int64) + final) * len(self.bytes_b)
        words, ends = [self.words[k] for k in word.tolist()], np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(words[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
        for to, x in zip(self.n, (n_a, n_b, n_groups, ok), strict=True):
            to.frombytes(x.astype(np.int64).tobytes())
        self.keys.frombytes((ids_a[i] << SHIFT | ids_b[j]).astype(np.int64).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(n_links)).astype(np.int64).tobytes())
        self.at.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += groups
        self.chars += sum(map(len, groups)) + sum(map(len, chunks))

    def align(self, texts: Iterable[str]):
        """For each text: tokens of A, of B, groups, the groups as text, and its linked pairs' keys with their number."""
        if len(self.groups) > KEPT or len(self.keys) > KEPT_LINKS or self.chars > KEPT_CHARS:
            self.clear()
        cuts = [CUT.split(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(x for chunks in cuts for x in chunks if x not in self.at)):
            self.add(new)
        n, ends, keys = [np.frombuffer(x, np.int64) for x in self.n], np.frombuffer(self.ends, np.int64), np.frombuffer(self.keys, np.int64)
        for chunks in cuts:
            own = [self.at[x] for x in chunks]
            at = np.array(own, np.int64)
            if not own or not n[3][at].all():
                yield 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            size = ends[at + 1] - ends[at]
            places = np.repeat(ends[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            found, times = np.unique(keys[places], return_counts=True)
            yield int(n[0][at].sum()), int(n[1][at].sum()), int(n[2][at].sum()), ";".join([self.groups[k] for k in own]), found, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of vocabularies and worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, whole: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`; its SHA-256 if not whole, '' without tokens), pairs of every document:
    the keys of its linked ids, `A << SHIFT | B`, with the number of its links that hold them."""
    pair = pa.struct([("key", pa.int64()), ("times", pa.int32())])
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"]

    def run(batches):
        own = aligner(path_a or vocabulary(), path_b or pieces())
        for part in slices(batches, 64):
            numbers, groups, keys, times = [], [], [], []
            for *n, text, found, often in own.align(part.column("text").to_pylist()):
                numbers.append(n)
                groups.append(text if whole or not text else hashlib.sha256(text.encode()).hexdigest())
                keys.append(found)
                times.append(often)
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(times).astype(np.int32))], fields=list(pair))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(x), pa.int64()) for x in zip(*numbers, strict=True)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(ends, pairs)], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<struct<key:long,times:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key, count (of the corpus's links that hold the pair) and is_best: whether no pair of its B id has a higher count."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.key").alias("key")).agg(F.sum("p.times").alias("count"))
    counts = cut(counts.withColumn("b", F.col("key").bitwiseAND((1 << SHIFT) - 1)), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("key", "count", (F.col("count") == F.col("most")).alias("is_best"))


def scored(aligned: DataFrame) -> DataFrame:
    """Adds n_links, n_best and count_sum to a table of aligned documents that is cheap to read again; drops pairs."""
    rows = cut(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.key", "p.times")
    met = join_checked(pairs, cut(pair_counts(rows), "counts"), ["key"], rows=PAIRS)
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.drop("pairs").join(sums, "row", "left").select(*[c for c in rows.columns if c not in ("row", "pairs")], *zero)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(align(table(spark, sf_dir, "documents"), whole=False))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
