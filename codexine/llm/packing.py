"""Packing by best-fit decreasing.

Documents become tokens, with an end token each. Overlong documents are first cut into full windows, which fill a
sequence each. What is left of every document is placed longest first into the open window that it fits most tightly;
a segment tree over remaining capacities finds that window. Pieces are dealt by hash into bins of a few thousand, and
each bin is packed by itself, so that work grows with the input and no task holds all pieces. Sequences are padded to
the window, except those whose length is a power of two.

Defined cases: a null text is the empty text, one piece of the end token; equal rows, also of equal ids, are packed
each; an empty table gives no pieces; extra columns aren't read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WORD, encoder, vocabulary
from .common import arrow, blank, cut, slices, table

WINDOW = 2048
END_ID = 1
#: Pieces that are packed together, on average.
BIN = 4096
#: Characters of texts beyond which op3's encoder makes the ids: the faster library fails on white space of about a million.
LONG = 1 << 18


class Fit:
    """Open windows by remaining capacity, with a segment tree over the capacities that says which have windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        k = capacity + self.size
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity of at least length that has an open window, or -1."""
        k = length + self.size
        if self.some[k]:
            return length
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.some[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1

    def take(self, capacity: int) -> int:
        window = self.windows[capacity].pop()
        k = capacity + self.size
        if not self.windows[capacity]:
            self.some[k] = 0
            k >>= 1
            while k:
                self.some[k] = self.some[2 * k] | self.some[2 * k + 1]
                k >>= 1
        return window


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset there of each piece, given longest first."""
    fit, used, windows, offsets = Fit(window), [], [], []
    for length in lengths:
        at = fit.tightest(length)
        if at < 0:
            at, k = window, len(used)
            used.append(0)
        else:
            k = fit.take(at)
        windows.append(k)
        offsets.append(used[k])
        used[k] += length
        if at > length:
            fit.put(at - length, k)
    return windows, offsets


_tokenizers: dict = {}


def tokenizer(path: str):
    """Ids of a byte-level vocabulary in the tokenizers library's format, by a faster library; tests hold them equal."""
    if path not in _tokenizers:
        import tiktoken

        from .bpe import Transducer

        own = Transducer(path)
        special = own.special
        ranks = {own.bytes[k]: k for k in range(len(own.bytes)) if k not in special.values() and own.bytes[k]}
        _tokenizers[path] = tiktoken.Encoding("pack", pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)
    return _tokenizers[path]


def pieces(documents: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and the rest of every document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        own, slow = tokenizer(path or vocabulary()), encoder(path or vocabulary())
        end = np.array([END_ID], "<u4").tobytes()
        for part in slices(batches):
            rows = [], [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = (b"".join(slow.ids(text)) if len(text) > LONG else np.array(own.encode(text, allowed_special="all"), "<u4").tobytes()) + end
                for at in range(0, len(raw), 4 * window):
                    piece = raw[at : at + 4 * window]
                    for to, x in zip(rows, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], part.schema.field("doc_id").type), *(pa.array(x, pa.int64()) for x in rows[1:])], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(parts: DataFrame, window: int = WINDOW, bin_size: int = BIN) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most a window."""
    parts = cut(parts, "pieces")
    bins = max(1, -(-parts.count() // bin_size))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        windows, offsets = best_fit(frame["length"].tolist(), window)
        frame["sequence_id"] = np.array(windows, np.int64) + (int(key[0]) << 32)
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns="bin")

    # A row's place in the table tells equal pieces apart, so many of them don't meet in a bin.
    binned = parts.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(bins)))
    out = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return binned.groupBy("bin").applyInPandas(run, f"{out}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
