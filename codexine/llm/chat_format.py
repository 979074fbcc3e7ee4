"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log has events of conversations: "delta" appends text to a message, "edit" replaces the message's text, "regenerate"
empties it and takes back the messages that began after it and before this event. Events are folded by sequence into
final messages: first those of one message (a message's text since its last edit or regenerate), then the messages of
one conversation. The messages are rendered with a template that marks roles and turns. Control strings in texts are
escaped, so the turns can be read back from the output exactly.

Defined cases: a null text is the empty text, a null role the empty role, a null conversation a conversation; null
sequences come first; events that tie are put in order by kind, role and text, and turns of one number, each by itself, by role and text; equal rows count each; a conversation
without messages isn't in the output; an empty table gives no rows (the query adds a conversation of its own); a long
conversation is one row; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank, table

#: The template: BEGIN role HEAD text END for each turn.
BEGIN, HEAD, END = "<s>[", "]\n", "</s>"
#: What can't stand in a text or role as it is. The first is replaced first and put back last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))
TRAINED = "assistant"
#: Characters of a delta.
DELTA = 1024


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, message, kind, role, text) to conv_id, turns array<struct<seq, role, text>> by sequence."""
    event = F.struct("seq", "kind", "role", "text")
    of_message = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    index = F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(0)))
    kept = F.expr("slice(log, _from + 1, size(log))")
    messages = of_message.withColumn("_from", F.array_max(index)).select(
        "conv_id",
        F.struct(
            F.col("log")[0]["seq"].alias("seq"),
            F.col("log")[0]["role"].alias("role"),
            F.array_join(F.transform(kept, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "").alias("text"),
            F.transform(F.filter("log", lambda x: x["kind"] == "regenerate"), lambda x: x["seq"]).alias("redone"),
        ).alias("turn"),
    )
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # A regenerate at r of a message begun at s takes back the messages begun in between.
    gaps = F.flatten(F.transform("turns", lambda t: F.transform(t["redone"], lambda r: F.struct(t["seq"].alias("a"), r.alias("b")))))
    turns = turns.withColumn("gaps", gaps)
    kept = F.when(F.size("gaps") == 0, F.col("turns")).otherwise(F.filter("turns", lambda t: ~F.exists("gaps", lambda g: (t["seq"] > g["a"]) & (t["seq"] < g["b"]))))
    return turns.select("conv_id", F.transform(kept, lambda t: F.struct(t["seq"], t["role"], t["text"])).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turns to conv_id, formatted, mask array<struct<start, length>>: the code points of formatted to train on."""
    piece = F.transform(
        "turns", lambda t: F.struct(F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(HEAD)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("trained"))
    )
    rows = conversations.select("conv_id", piece.alias("pieces")).withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    seed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def step(state, p):
        start, length = state["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.when(p["trained"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"))

    return rows.select("conv_id", "formatted", F.aggregate("pieces", seed, step)["mask"].alias("mask"))


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(F.substring(formatted, F.lit(1), F.length(formatted) - len(END)), "</s>", -1)
    head = lambda p: F.instr(p, HEAD)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(BEGIN) + 1), head(p) - (len(BEGIN) + 1))).alias("role"),
            unescape(F.substring(p, head(p) + len(HEAD), F.length(p))).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))))


def events_of(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """A table of whole turns as a log: each turn is streamed as deltas of at most so many characters, in sequence."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    # Each row is a message of its own, even if a turn comes twice.
    rows = rows.withColumn("message", F.struct("turn", F.monotonically_increasing_id().alias("row")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest((F.ceil(F.length("text") / delta) - 1).cast("int"), F.lit(0)))))
    piece = F.substring("text", F.col("part") * delta + 1, F.lit(delta))
    return rows.select("conv_id", F.struct("turn", "part").alias("seq"), F.lit("delta").alias("kind"), "role", piece.alias("text"), "message")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all conversations and of conversation -7, read back from the formatted output."""
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = render(fold(events_of(rows)))
    turns, loss = read_back(F.col("formatted")), F.array_join(masked(F.col("formatted"), F.col("mask")), "")
    return out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
