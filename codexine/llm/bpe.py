"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list has a sufficient lookahead: a number of bytes such that what stands further right can't change a token. A
chain of merges, each of which is overlapped on its right by one of higher priority, carries an influence one token
further per link; so the longest such chain times the longest token bounds the lookahead. The transducer keeps a window
of bytes, merges it, emits the tokens that end at least the lookahead before the window's end, and keeps the rest; a
suffix of a tokenization is the tokenization of the suffix's bytes, so it goes on from there. Memory depends on the
lookahead and the block, not on the text. Words that a window holds whole go through one merge, and are kept in a
bounded cache. Texts are cut into words in blocks, with the last word of a block held back until its end is certain.
Decoding feeds bytes to an incremental UTF-8 state machine.

Defined cases: a null text is the empty text, of no tokens; the strings of special tokens become their ids, as the
tokenizers library does it; equal rows stay; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blank, slices, table

BLOCK = 1 << 16
CACHE = 400_000
#: Words up to so many characters are kept in the cache.
CACHED = 64


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Words of the byte-level scheme; fixed values.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The runs of one class that a very long word consists of.
RUNS = {"letter": r"\p{L}*", "number": r"\p{N}*", "space": r"\s*", "other": r"[^\s\p{L}\p{N}]*"}


@lru_cache(1)
def patterns():
    return regex.compile(WORD), {k: regex.compile(v) for k, v in RUNS.items()}


class Transducer:
    """Merges of one vocabulary, over bytes that come in parts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes = [b""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.bytes[k] = raw(token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.byte_ids = [0] * 256
        for token, k in vocab.items():
            if len(token) == 1:
                self.byte_ids[letters[token]] = k
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lookahead = self._lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @staticmethod
    def _lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
        """Longest chain of rules, each overlapped on its right by one of higher priority, times the longest token."""
        reach: dict[bytes, int] = {}
        longest, most = 1, 1
        for a, b in pairs:  # by priority, highest first
            chain = 1 + max(reach.get(b[k:], 0) for k in range(len(b)))
            token = a + b
            for k in range(1, len(token)):
                if reach.get(token[:k], 0) < chain:
                    reach[token[:k]] = chain
            longest, most = max(longest, chain), max(most, len(token))
        return longest * most

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a whole window: the pair of the lowest rank first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is _NONE:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), _NONE)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, joined = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = joined, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if m := get((joined, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, joined, ids[after[k]], m[1]))
            if before[k] >= 0 and (m := get((ids[before[k]], joined))):
                heapq.heappush(heap, (m[0], before[k], ids[before[k]], joined, m[1]))
        return [x for x in ids if x >= 0]

    def stream(self, parts: Iterable[bytes], block: int = BLOCK) -> Iterator[list[int]]:
        """Tokens of one word that comes in parts, each emitted once it is stable."""
        window = b""
        for part in parts:
            window += part
            while len(window) >= self.lookahead + block:
                stable, end, out = len(window) - self.lookahead, 0, []
                for k in self.merge(window):
                    if end + len(self.bytes[k]) > stable:
                        break
                    end += len(self.bytes[k])
                    out.append(k)
                if not end:
                    break  # a token longer than a block; more bytes will do
                yield out
                window = window[end:]
        if window:
            yield self.merge(window)


_NONE = (1 << 60, -1)


class WordCache(dict):
    """Tokens of a word as little-endian 32-bit ids; emptied when it is full, so its memory is bounded."""

    def __init__(self, encode, most: int = CACHE):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encode(word.encode()), "<u4").tobytes()
        if len(word) <= CACHED:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Encodes texts in blocks, and decodes ids in blocks."""

    def __init__(self, path: str, merge=None):
        self.transducer = Transducer(path)
        self.cache = WordCache(merge or self._word)
        self.word, self.runs = patterns()

    def _word(self, data: bytes) -> list[int]:
        return [k for part in self.transducer.stream([data]) for k in part]

    def ids(self, text: str, block: int = BLOCK) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, in parts of about a block."""
        at = 0
        for m in self.transducer.special_at.finditer(text) if self.transducer.special_at else ():
            yield from self._plain(text, at, m.start(), block)
            yield np.array([self.transducer.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text), block)

    def plain(self, text: str, block: int = BLOCK) -> Iterator[bytes]:
        """The ids where the strings of special tokens are plain text."""
        return self._plain(text, 0, len(text), block)

    def _plain(self, text: str, at: int, end: int, block: int) -> Iterator[bytes]:
        cache, word = self.cache, self.word
        while end - at > block + 8:
            part = text[at : at + block]
            words = word.findall(part)
            size = sum(map(len, words))  # every character belongs to a word
            # Three characters at least must follow a word for its end to be certain.
            while words and size > block - 3:
                size -= len(words.pop())
            if words:
                yield b"".join(map(cache.__getitem__, words))
                at += size
            else:
                at = yield from self._long(text, at, end, block)
        if at < end:
            yield b"".join(map(cache.__getitem__, word.findall(text[at:end])))

    def _long(self, text: str, at: int, end: int, block: int) -> Iterator[bytes]:
        """A word that is longer than a block; returns its end."""
        first = text[at]
        kinds = [k for k, run in self.runs.items() if run.match(text[at + 1 if first == " " else at]).end()]
        kind = "space" if first != " " and self.runs["space"].match(first).end() else kinds[0]
        run = self.runs[kind]
        stop = at + (first == " ")

        def parts():
            nonlocal stop
            yield text[at:stop].encode()
            while stop < end:
                m = run.match(text, stop, min(end, stop + block))
                upto = m.end()
                if kind == "space" and upto < end and (upto == stop + block or not run.match(text[upto]).end()):
                    upto -= 1  # the last space before a word goes with it
                if upto == stop:
                    return
                yield text[stop:upto].encode()
                stop = upto

        for out in self.transducer.stream(parts(), block):
            yield np.array(out, "<u4").tobytes()
        return stop

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come in parts; bytes that aren't UTF-8 become U+FFFD, as the library does it."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.transducer.bytes
        for part in parts:
            yield state.decode(b"".join([token[k] for k in np.frombuffer(part, "<u4").tolist()]))
        yield state.decode(b"", True)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded text of every document."""

    def run(batches):
        own = encoder(path or vocabulary())
        for part in slices(batches, 64):
            ids = [list(own.ids(t)) for t in part.column("text").to_pylist()]
            flat = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in ids]
            ends = np.cumsum([0, *map(len, flat)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(["".join(own.decode(x)) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; a text's ids and decoded text exist a block at a time."""

    def run(batches):
        own = encoder(path or vocabulary())
        names = [str(k) for k in range(len(own.transducer.bytes))]
        for part in slices(batches):
            n, of_ids, of_text = [], [], []
            for text in part.column("text").to_pylist():
                count, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                state = codecs.getincrementaldecoder("utf-8")("replace")
                token = own.transducer.bytes
                for raw in own.ids(text):
                    numbers = np.frombuffer(raw, "<u4").tolist()
                    if numbers:
                        ids.update(("," * bool(count) + ",".join([names[k] for k in numbers])).encode())
                        decoded.update(state.decode(b"".join([token[k] for k in numbers])).encode())
                        count += len(numbers)
                decoded.update(state.decode(b"", True).encode())
                n.append(count), of_ids.append(ids.hexdigest()), of_text.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow(documents.select("doc_id", blank("text").alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
