"""Alignment of tokenizers, SimHash and repair of conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codexine.llm import conversation_repair, line_dedup, simhash, token_alignment, vector_topk
from codexine.llm.bpe import vocabulary

from .test_models import read

ODD = ["", None, " ", "  ", "x", " x", "x ", "x  ", "a\n  b", "a \n b\t c", "▁x y", "<|endoftext|> a <s> </s> <unk> <0x41>", "\x00 a\x1c b", "é  x　y", "ﬁ    z", "😀😀 don't I'll", "́a é", "x" * 300, " " * 300, "\n" * 5 + "a", "﻿a", "\x85 b", "12345 6,7.8!? \r\n c"]


@lru_cache(1)
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.pieces())
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    letters = {chr(k) if k in own else chr(next(more)): k for k in range(256)}
    bytes_a = {k: bytes(letters[c] for c in t) for t, k in a.get_vocab().items() if t != "<|endoftext|>"}
    bytes_b = {k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())}
    return a, b, bytes_a, bytes_b


def plain_alignment(texts):
    """Rows of op11 from whole texts, by the libraries and by scanning ends."""
    a, b, bytes_a, bytes_b = libraries()
    rows, count = [], Counter()
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[k] for k in ids[0]) != raw or b"".join(bytes_b[k] for k in ids[1]) != raw:
            rows.append(None)
            continue
        spans = [[], []]
        for own, table, to in zip(ids, (bytes_a, bytes_b), spans, strict=True):
            at = 0
            for k in own:
                to.append((at, at := at + len(table[k])))
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in both:
            groups.append("|".join(",".join(str(k) for k, (s, e) in zip(own, span, strict=True) if begin <= s and e <= end) for own, span in zip(ids, spans, strict=True)))
            begin = end
        ends = {e: k for k, (_, e) in zip(ids[1], spans[1], strict=True)}
        links = [(k, ends[e]) for k, (_, e) in zip(ids[0], spans[0], strict=True) if e in ends]
        count.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    for r in rows:
        if r is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield *r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]


def test_alignment_against_whole_texts(spark, tables, sf_dir, monkeypatch):
    texts = [*ODD, *[d["text"] for d in read(sf_dir, "documents")[:60]], "the same words"] + ["the same words"] * 30
    where = tables(documents=[(k % 80 if k else None, t) for k, t in enumerate(texts)])
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((k % 80 if k else None, *r) for k, r in enumerate(plain_alignment(texts)))
    for pairs in (token_alignment.PAIRS, 0):  # with and without a broadcast
        monkeypatch.setattr(token_alignment, "PAIRS", pairs)
        out = token_alignment.op11_token_alignment(spark, where)
        assert out.columns == columns and Counter(map(tuple, out.collect())) == want
    out = token_alignment.op11_token_alignment(spark, tables_empty(spark, where))
    assert out.columns == columns and out.count() == 0


def tables_empty(spark, where):
    to = where + "/empty"
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{to}/{name}.parquet")
    return to


def test_chunks_of_random_texts_align_as_whole_ones():
    dice = random.Random(4)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", ".", "'s", "é", " ", "▁", "12", "😀", "\r", "\x1f", "　", "ing"]
    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randint(1, 40))) for _ in range(1500)]
    own = token_alignment.Aligner(vocabulary(), token_alignment.pieces())
    got = [(*n, hashlib.sha256(g.encode()).hexdigest() if g else "") for part in range(0, 1500, 100) for *n, g, _, _ in own.align(texts[part : part + 100])]
    assert got == [(r[0], r[1], r[2], r[6]) for r in plain_alignment(texts)]


def test_components_of_overlapping_tokens():
    dice = np.random.default_rng(2)
    for _ in range(50):
        n = int(dice.integers(1, 60))
        a, b = (np.unique(np.append(dice.integers(1, n + 1, dice.integers(1, n + 1)), n)) for _ in range(2))
        of_a, of_b = token_alignment.groups_of(a, b)
        both = np.intersect1d(a, b)
        assert of_a.tolist() == np.searchsorted(both, a).tolist() and of_b.tolist() == np.searchsorted(both, b).tolist()


def test_a_store_that_is_full_is_emptied(monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT", 5)
    own = token_alignment.Aligner(vocabulary(), token_alignment.pieces())
    texts = [f"word{k} and {k} more" for k in range(50)]
    got = [n for k in range(0, 50, 10) for *n, _, _, _ in own.align(texts[k : k + 10])]
    assert len(own.groups) <= 60 and got == [[r[0], r[1], r[2]] for r in plain_alignment(texts)]


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(codes, radius=3):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = np.array(sorted(root), np.uint64)
    for k, c in enumerate(distinct):
        for other in distinct[k + 1 :][np.bitwise_count(distinct[k + 1 :] ^ c) <= radius]:
            a, b = sorted((find(int(c)), find(int(other))))
            root[b] = a
    return {c: find(c) for c in root}


def test_simhash_against_brute_force(spark, tables, sf_dir):
    base = [d["text"] for d in read(sf_dir, "documents")]
    words = " ".join(base).split()[:3000]
    near = [" ".join([*words[:2000], *words[2000 + k : 2003 + k]]) for k in range(40)]
    texts = ["", None, " \n", "One", "one TWO", "ONE two\x0bthree", "É x y z", *base, *near, *near[:3], "long " * 200000]
    docs = [(k if k % 11 else None, t) for k, t in enumerate(texts)] + [(5, "One")]
    codes = [plain_fingerprint(t) for _, t in docs]
    root = plain_classes(codes)
    least = {}
    for (k, _), c in zip(docs, codes, strict=True):
        if k is not None:
            least[root[c]] = min(k, least.get(root[c], k))
    out = simhash.op12_simhash(spark, where := tables(documents=docs))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, out.collect())) == Counter((k, f"{c:016x}", least.get(root[c])) for (k, _), c in zip(docs, codes, strict=True))
    assert max(Counter(root[c] for c in set(codes)).values()) > 5
    assert simhash.op12_simhash(spark, tables_empty(spark, where)).count() == 0


@pytest.mark.parametrize("small", [4096, 16])
def test_links_of_crowded_fingerprints(spark, small):
    """Also in buckets that are split by the other bits, and in such that stay large."""
    dice = np.random.default_rng(3)
    centres = dice.integers(0, 2**64, 6, dtype=np.uint64)
    codes = {int(c) for c in centres} | set(dice.integers(0, 2**64, 300, dtype=np.uint64).tolist())
    for c in centres[:3].tolist():
        codes |= {c ^ sum(1 << int(k) for k in dice.choice(64, dice.integers(1, 7), replace=False)) for _ in range(150)}
    codes |= {int(centres[4]) ^ (1 << a) ^ (1 << b) for a, b in combinations(range(8), 2)}
    want = plain_classes(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, small).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in edges)
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {c: find(c) for c in root} == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_sliced_distances(radius):
    dice = np.random.default_rng(radius)
    codes = dice.integers(0, 2**64, 200, dtype=np.uint64)
    codes[1::2] = codes[::2] ^ np.array([sum(1 << int(k) for k in dice.choice(64, dice.integers(0, 10), replace=False)) for _ in range(100)], np.uint64)
    sliced = simhash.planes(codes)
    for shift in (1, 2, 63, 64, 65, 128, 199):
        n = 200 - shift
        valid = dice.random(n) < 0.9
        words = np.packbits(np.pad(valid, (0, -n % 64)), bitorder="little").view("<u8")
        got = np.unpackbits(simhash.within(sliced, words, shift, radius).view(np.uint8), bitorder="little")[:n]
        assert got.tolist() == (valid & (np.bitwise_count(codes[:n] ^ codes[shift:]) <= radius)).astype(int).tolist()


SPACES = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """All cheapest edits of one conversation by a search over (row, state), with the least letters of each."""
    nothing, fits = (0, "", ()), {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(k, state, room):
        """Cost, letters and result from row k on; room: insertions that may still stand here (more never help)."""
        ways = [nothing] if k == len(rows) and state in ("", "a") else []
        add = lambda cost, letter, out, rest: ways.append((cost + rest[0], letter + rest[1], (*out, *rest[2]))) if rest else None
        if room:
            for now in (x for x in fits[state].values() if x != "s"):
                add(3, "I", [f"{'user' if now == 'u' else 'assistant'}:"], best(k, now, room - 1))
        if k < len(rows):
            role, text = rows[k]
            add(4, "D", [], best(k + 1, state, 3))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                if role[:1] in fits[state]:
                    add(more, "K", [f"{role}:{text}"], best(k + 1, fits[state][role[:1]], 3))
                for now in (x for x in fits[state].values() if x != "s"):
                    add(3 + more, "R", [f"{'user' if now == 'u' else 'assistant'}:{text}"], best(k + 1, now, 3))
        return min(ways, key=lambda w: w[:2]) if ways else None

    cost, audit, out = best(0, "", 3)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_op13(conversations):
    of = {r[0]: [] for r in conversations}
    for conv_id, turn, role, text in conversations:
        spaced = [" " if x is None else str(x) for x in (conv_id, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2:]
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        of[conv_id] += [row] * {0: 0, 3: 2}.get(kind, 1)
    for conv_id, rows in of.items():
        rows.sort()
        turns = {r[1] for r in rows if r[0]}
        yield conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain_repair(tuple(r[2:] for r in rows))


def random_conversations(n):
    dice = random.Random(8)
    role = lambda: dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sam", "util"])
    text = lambda: dice.choice(["Yes.", "no", "What? ", "", " \n", None, "Good!\t", "x. ", "a", "b.", "c.", "d"])
    rows = []
    for k in range(n):
        turn = 0
        for _ in range(dice.randint(1, 14)):
            turn += dice.choice([0, 1, 1, 1, 1, 2, 5])
            rows.append((k if k % 50 else None, turn if dice.random() > 0.05 else None, role(), text()))
    return rows


@pytest.mark.parametrize(("most", "most_bytes"), [(4096, 1 << 20), (3, 1 << 20), (1, 1), (4096, 20)])
def test_repair_against_brute_force(spark, most, most_bytes):
    rows = random_conversations(250)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.digested(df.select("conv_id").distinct(), conversation_repair.cut(conversation_repair.judged(conversation_repair.damaged(df))), most, most_bytes)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_op13(rows)))


def test_repair_query(spark, sf_dir, tables):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read(sf_dir, "conversations")]
    out = conversation_repair.op13_conversation_repair(spark, sf_dir)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(plain_op13(rows))
    more = [*rows, *[(10**6, 1, "user", "again.")] * 5000, *[(10**6 + 1, k, ("user", "assistant")[k % 2], f"{k}." + "x " * 10 + ".") for k in range(5000)], (None, None, None, None)]
    where = tables(conversations=more)
    got = {r["conv_id"]: tuple(r) for r in conversation_repair.op13_conversation_repair(spark, where).collect()}
    plain = {r[0]: r for r in plain_op13([r for r in more if r[0] is None or r[0] < 10**6])}
    assert {k: v for k, v in got.items() if k is None or k < 10**6} == plain
    assert len(got[10**6][7]) % 5000 <= 2 and len(got) == len(plain) + 2
    assert conversation_repair.op13_conversation_repair(spark, tables_empty(spark, where)).count() == 0


def test_vectors_of_huge_components(spark, tables):
    """Integers and scores beyond 64 bits count as the nearest ones; no row is lost."""
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [1e16, -1e16]), (20, [2.0**57, 0.0]), (4, [-(2.0**57), 0.0]), (5, [0.5, 0.25])]
    out = vector_topk.op5_vector_topk(spark, tables(embeddings=rows)).collect()
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    ints = {k: [clip(int(np.floor(float(np.float32(c)) * 64))) for c in v] for k, v in rows}
    want = set()
    for q in (0, 20):
        scores = sorted(((-clip(sum(a * b for a, b in zip(ints[q], v, strict=True))), k) for k, v in ints.items() if k != q))
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out} == want


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7, 8, 9), (2, "a\nb\nc", 1, 2, 3)], "doc_id long, text string, _ld_key int, _ld_lines int, _LD_REMOVED int")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "_ld_key", "_ld_lines", "_LD_REMOVED", *line_dedup.added(df)]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 7, 8, 9, 3, 0), (2, "", 1, 2, 3, 3, 3)]
