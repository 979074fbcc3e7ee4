"""Repair of a conversation's structure by a time-major dynamic program.

A conversation should be `(s?(ua)+)?` by the initials of its roles. Rows are kept, given another role, or deleted, and
empty turns inserted, at the least cost. Of the cheapest ways the one with the least letters (Delete, Insert, Keep,
Rerole) is taken. The state after a prefix is one of four: nothing, a system turn, a user turn, an assistant turn; in
each only one role may be inserted, so letters alone tell what comes out.

Rows are sorted by conversation and turn, in ranges, and cut into chunks of at most CHUNK rows or CHUNK_BYTES of text, so
a long conversation is never in one task. Chunks of alike length are a tensor, time first: codes [T, B], costs
[T + 1, B, states]. From the last row back every turn's costs are updated for all B at once and kept; from the first row
on letters are traced for all B at once. Of a conversation of several chunks, each chunk first gives its costs for every
state at its end (a matrix of least sums); matrices, then the states at the ends, are carried along its chunks, which are
few numbers each. Equal rows of one turn are one row with a number: all but the first are deleted.

Defined cases: a null id, turn, role or text is a space in the key that is damaged by and in what is compared and put out;
rows of a null id are one conversation; rows of equal turns come by role, then by text, after damage; a null turn comes
first and has no part in gaps; roles of other initials are rerolled or deleted; a conversation whose rows are all dropped
has zeros; a text longer than a chunk is one of its own; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, table

CHUNK, CHUNK_BYTES = 4096, 1 << 20
#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: The one role that may follow each state, as its state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code: its role's initial, and flags; PAD fills a tensor up.
INITIALS, OTHER = {"s": 0, "u": 1, "a": 2}, 3
GONE, CUT_OFF, PAD = 4, 8, 16
AFTER = np.array([SYSTEM, USER, ASSISTANT, START])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code and state: costs of Keep and Rerole; by code: cost of Delete."""
    keep, rerole, delete = np.full((17, 4), NEVER), np.full((17, 4), NEVER), np.full(17, DELETE)
    for code in range(16):
        if not code & GONE:
            more = TRUNCATED if code & CUT_OFF else 0
            rerole[code] = REROLE + more
            initial = code & 3
            if initial != OTHER:
                allowed = [START] if initial == INITIALS["s"] else np.flatnonzero(NEXT == AFTER[initial])
                keep[code, allowed] = more
    delete[PAD] = 0
    return keep, rerole, delete


KEEP_COST, REROLE_COST, DELETE_COST = _tables()
FINAL = np.array([0, NEVER, NEVER, 0])


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs [..., states] where turns may be inserted first."""
    user, assistant = np.minimum(costs[..., USER], INSERT + costs[..., ASSISTANT]), np.minimum(costs[..., ASSISTANT], INSERT + costs[..., USER])
    return np.stack([np.minimum(costs[..., START], INSERT + user), np.minimum(costs[..., SYSTEM], INSERT + user), user, assistant], -1)


def backward(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs [T + 1, B, states] from each turn on. codes: [T, B]; last: [B, states] at the end, insertions included."""
    costs = np.empty((len(codes) + 1, *last.shape), np.int64)
    costs[-1] = last
    for t in range(len(codes) - 1, -1, -1):
        then, code = costs[t + 1], codes[t]
        kept = KEEP_COST[code] + then[np.arange(len(code)), AFTER[code & 3]][:, None]
        best = np.minimum(np.minimum(DELETE_COST[code][:, None] + then, kept), REROLE_COST[code] + then[:, NEXT])
        costs[t] = np.where((code == PAD)[:, None], then, inserted(best))
    return np.minimum(costs, NEVER)


def traced(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and the states behind them, [T + 1, 3, B], two insertions and an edit for every turn; and the states at the end.

    ends: whether the conversation ends with its chunk; only there turns are inserted behind the last row."""
    turns, width = codes.shape
    letters, states = np.zeros((turns + 1, 3, width), np.uint8), np.zeros((turns + 1, 3, width), np.uint8)
    each = np.arange(width)
    state = state.copy()
    for t in range(turns + 1):
        at_end = t == turns
        code = np.full(width, PAD) if at_end else codes[t]
        then = costs[t] if at_end else costs[t + 1]
        todo = ends.copy() if at_end else code != PAD
        for k in range(3):
            now = costs[t, each, state]
            delete = todo & (not at_end) & (DELETE_COST[code] + then[each, state] == now)
            insert = todo & ~delete & (INSERT + costs[t, each, NEXT[state]] == now) if k < 2 else np.zeros(width, bool)
            rest = todo & ~delete & ~insert & (not at_end)
            keep = rest & (KEEP_COST[code, state] + then[each, AFTER[code & 3]] == now)
            rerole = rest & ~keep
            slot = np.where(insert, k, 2)
            for chosen, letter, behind in ((delete, "D", state), (insert, "I", NEXT[state]), (keep, "K", AFTER[code & 3]), (rerole, "R", NEXT[state])):
                letters[t, slot[chosen], each[chosen]] = ord(letter)
                states[t, slot[chosen], each[chosen]] = behind[chosen]
            state = np.where(insert | rerole, NEXT[state], np.where(keep, AFTER[code & 3], state))
            todo = insert
    return letters, states, state


def tensors(lengths: np.ndarray):
    """Places of chunks whose lengths lie between the same powers of two, so that a tensor is at most half padding."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        step = max(1, (1 << 18) >> int(k))
        for at in range(0, len(own), step):
            yield own[at : at + step]


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((max(map(len, codes)), len(codes)), PAD)
    for k, c in enumerate(codes):
        out[: len(c), k] = c
    return out


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after damage, with the number of equal ones."""
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """rows of damaged() with fault: 1 blank, 2 duplicate, 3 truncated, 0 none; of the first of n equal ones."""
    # Two hashes of a text, which also tell texts apart at any size.
    same = [F.xxhash64("text").alias("same"), F.xxhash64(F.lit("more"), "text").alias("more")]
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    rows = cut(rows.select("*", *same, place.alias("place")), "damaged")
    first = rows.groupBy("conv_id", "role", "same", "more").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # As a table of its own, so that Spark may split the join where a conversation repeats one text.
    first = cut(first.select(F.col("conv_id").alias("own_id"), F.col("role").alias("own_role"), F.col("same").alias("own_same"), F.col("more").alias("own_more"), "first"), "first")
    on = rows["conv_id"].eqNullSafe(first["own_id"]) & (rows["role"] == first["own_role"]) & (rows["same"] == first["own_same"]) & (rows["more"] == first["own_more"])
    rows = rows.join(first, on, "left")
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    again = F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    fault = F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "n", fault.cast("int").alias("fault"))


def counts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated of judged rows."""
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == 1, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == 2, F.col("n")).when(F.col("fault") != 1, F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum((F.col("fault") == 3).cast("long")).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    return turns.groupBy("conv_id").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def _illegal(initials: np.ndarray) -> np.ndarray:
    """Whether each two neighbours are neither su, ua nor au."""
    return ~np.isin(4 * initials[:-1] + initials[1:], (1, 6, 9))


def chunks(rows: DataFrame, most: int = CHUNK, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Judged rows in their order as chunks of a conversation, ordered by part and seq, which together are unique."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    flag = F.when(F.col("fault").isin(1, 2), GONE).when(F.col("fault") == 3, CUT_OFF).otherwise(0)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(ranges, *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    names = ["conv_id", "part", "seq", "codes", "n", "roles", "texts"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        part, seq, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def chunk(kind):
            codes, n, roles, texts = zip(*held, strict=True)
            row = [key, part, seq, bytes(codes), n, roles, texts]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [kind, *types], strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "code", "n", "role", "text")), strict=True):
                if held and (own != key or len(held) >= most or size >= most_bytes):
                    yield chunk(kind)
                    seq, held, size = seq + 1, [], 0
                key = own
                held.append(row)
                size += len(row[3])
        if held:
            yield chunk(kind)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return arrow(spread.select("conv_id", (code + flag).alias("code"), "n", "role", "text"), run, f"conv_id {kind}, part int, seq long, codes binary, n array<long>, roles array<string>, texts array<string>")


def _codes(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).astype(np.int64) for x in batch.column("codes").to_pylist()]


def _carried(parts: DataFrame) -> DataFrame:
    """part, seq, last (costs behind the chunk), entry (the state before it), ends and apart (whether the first row doesn't fit the one
    before) of the chunks of conversations that have several."""

    def matrices(batches):
        for batch in batches:
            codes, out = _codes(batch), []
            for own in codes:
                units = np.where(np.eye(4, dtype=bool), 0, NEVER)  # a column for each state at the end
                out.append(backward(np.repeat(own[:, None], 4, 1), units)[0].T.ravel())
            edge = [pa.array([int(c[k]) & 3 for c in codes], pa.int32()) for k in (0, -1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq", "codes")), pa.array([m.tolist() for m in out], pa.list_(pa.int64())), *edge], ["conv_id", "part", "seq", "codes", "matrix", "head", "tail"])

    def lasts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "seq"])
        last, out = inserted(FINAL), []
        for matrix in reversed(frame["matrix"].tolist()):
            out.append(last.tolist())
            last = (np.asarray(matrix).reshape(4, 4) + last[None]).min(1)
        edge = np.stack([frame["tail"].to_numpy()[:-1], frame["head"].to_numpy()[1:]])
        apart = [0, *(int(_illegal(x)[0]) for x in edge.T)]
        return pd.DataFrame({"part": frame["part"], "seq": frame["seq"], "last": out[::-1], "ends": [*[False] * (len(frame) - 1), True], "apart": apart})

    def exits(batches):
        for batch in batches:
            out = []
            for own, last, ends in zip(_codes(batch), batch.column("last").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                codes = np.repeat(own[:, None], 4, 1)
                costs = backward(codes, np.repeat(np.array(last)[None], 4, 0))
                out.append(traced(codes, costs, np.arange(4), np.full(4, ends))[2].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq", "last", "ends", "apart")), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "part", "seq", "last", "ends", "apart", "exits"])

    def entries(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "seq"])
        state, out = START, []
        for own in frame["exits"]:
            out.append(state)
            state = int(own[state])
        return pd.DataFrame({"part": frame["part"], "seq": frame["seq"], "last": frame["last"], "ends": frame["ends"], "apart": frame["apart"], "entry": out})

    kind = parts.schema["conv_id"].dataType.simpleString()
    first = cut(arrow(parts.select("conv_id", "part", "seq", "codes"), matrices, f"conv_id {kind}, part int, seq long, codes binary, matrix array<long>, head int, tail int"), "matrices")
    last = first.drop("codes").groupBy("conv_id").applyInPandas(lasts, "part int, seq long, last array<long>, ends boolean, apart int")
    met = arrow(first.select("conv_id", "part", "seq", "codes").join(last, ["part", "seq"]), exits, f"conv_id {kind}, part int, seq long, last array<long>, ends boolean, apart int, exits array<int>")
    return met.groupBy("conv_id").applyInPandas(entries, "part int, seq long, last array<long>, ends boolean, apart int, entry int")


def repair(rows: DataFrame, most: int = CHUNK, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """conv_id, part, seq, alone, illegal, cost, audit, messages (role, text) of judged rows: a row for every chunk of a conversation,
    in the order of part and seq; alone: the conversation has one."""
    parts = cut(chunks(rows, most, most_bytes), "chunks")
    many = cut(parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("own")), "many")
    if many.take(1):
        several = parts.join(many, parts["conv_id"].eqNullSafe(many["own"]), "left_semi")
        parts = parts.join(cut(_carried(several), "carried"), ["part", "seq"], "left")
    else:
        parts = parts.select("*", F.lit(None).cast("array<long>").alias("last"), F.lit(None).cast("boolean").alias("ends"), F.lit(0).alias("apart"), F.lit(None).cast("int").alias("entry"))
    message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    names = ["conv_id", "part", "seq", "alone", "illegal", "cost", "audit", "messages"]

    def out_of(own, n, roles, texts, letters, states):
        copies = np.zeros((len(letters), 4), np.int64)
        copies[:, :3] = letters > 0
        copies[: len(n), 3] = n - 1
        spelled = np.concatenate([letters, np.full((len(letters), 1), ord("D"), np.uint8)], 1)
        audit = np.repeat(spelled.ravel(), copies.ravel()).tobytes().decode()
        messages = []
        for t, k in np.argwhere((letters > 0) & (letters != ord("D"))).tolist():
            letter, state = chr(letters[t, k]), states[t, k]
            messages.append({"role": roles[t] if letter == "K" else ROLES[state], "text": "" if letter == "I" else texts[t]})
        initials = own & 3
        return int((n - 1).sum() + _illegal(initials).sum()), int(DELETE * (n - 1).sum()), audit, messages

    def run(batches):
        for batch in batches:
            codes, n = _codes(batch), [np.array(x) for x in batch.column("n").to_pylist()]
            roles, texts = batch.column("roles").to_pylist(), batch.column("texts").to_pylist()
            last, ends, entry, apart = (batch.column(c).to_pylist() for c in ("last", "ends", "entry", "apart"))
            done: list = [None] * len(codes)
            for at in tensors(np.array([len(c) for c in codes])):
                tensor = _padded([codes[k] for k in at])
                final = np.array([inserted(FINAL) if last[k] is None else last[k] for k in at])
                begun = np.array([START if entry[k] is None else entry[k] for k in at])
                costs = backward(tensor, final)
                letters, states, state = traced(tensor, costs, begun, np.array([ends[k] is not False for k in at]))
                for j, k in enumerate(at):
                    illegal, more, audit, messages = out_of(codes[k], n[k], roles[k], texts[k], letters[:, :, j], states[:, :, j])
                    cost = int(costs[0, j, begun[j]]) - (int(costs[-1, j, state[j]]) if ends[k] is False else 0)
                    done[k] = ends[k] is None, illegal + (apart[k] or 0), cost + more, audit, messages
            columns = zip(zip(*done, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.string(), message), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *(pa.array(x, t) for x, t in columns)], names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return arrow(parts, run, f"conv_id {kind}, part int, seq long, alone boolean, illegal long, cost long, audit string, messages array<struct<role:string,text:string>>")


def _streamed_digests(pieces: DataFrame) -> DataFrame:
    """conv_id, digest of conversations of several chunks, whose texts go through the digest's state a chunk at a time."""

    def run(batches):
        key, state, begun, some = None, None, False, False
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for own, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if some and own != key:
                    yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["conv_id", "digest"])
                if not some or own != key:
                    key, state, begun, some = own, hashlib.sha256(), False, True
                if text is not None:
                    state.update((("\n" if begun else "") + text).encode())
                    begun = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["conv_id", "digest"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return arrow(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "text"), run, f"conv_id {kind}, digest string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digested(conversations.select("conv_id").distinct(), cut(judged(damaged(conversations)), "judged"))


def digested(ids: DataFrame, rows: DataFrame, most: int = CHUNK, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The contract's columns for every conv_id of ids, from judged rows."""
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    pieces = cut(repair(rows, most, most_bytes), "repaired").withColumn("text", F.when(F.size("messages") > 0, joined))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "")
    # One letter for each row: a conversation's audit, and the list that it is made of, are as long as its column has to be.
    whole = pieces.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"), F.max(F.when(F.col("alone"), F.sha2(F.coalesce("text", F.lit("")), 256))).alias("alone"))
    digests = _streamed_digests(pieces.filter(~F.col("alone")).select("conv_id", "part", "seq", "text"))
    out, of = ids, {"counts": counts(rows), "whole": whole, "digests": digests}
    for name, df in of.items():
        df = df.withColumnRenamed("conv_id", name)
        out = out.join(df, out["conv_id"].eqNullSafe(df[name]), "left").drop(name)
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("alone", "digest", F.sha2(F.lit(""), 256))
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), digest.alias("repaired_sha256"))
