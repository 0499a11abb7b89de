"""Chat formatting of typed content parts, with a loss mask that can be read back.

A visitor over the parts of a message turns each into text: text parts are escaped, image, audio
and document parts become numbered placeholders whose attachment reference and expanded token count
are recorded. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One turn is START + role, a line feed, the text, END.
START, END = "<|turn|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
#: Strings that control a chat model; each is a first character and a rest.
CONTROL = r"(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(text: Column) -> Column:
    """Doubles each backslash and puts one into each control string, so that none is left."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\n", "\\\\\n")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def parts_of_text(text: Column) -> Column:
    """A message's text as its only part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, loss_spans, attachments, expanded_tokens.

    parts is an array of (type, text, ref, tokens). Text parts are escaped; image, audio and document
    parts become `<|type:k|>`, k counting the conversation's attachments from 0, with
    (k, type, ref, tokens, turn) in `attachments`. Parts of another type count as text; null parts,
    texts and roles are empty. Turns are ordered by turn (null first), then role and text; repeated
    rows are turns of their own. expanded_tokens is words of text plus attachments' tokens (null: 0).
    loss_spans holds (start, length) in code points, from 0, of each assistant text within `formatted`.
    A conversation is one row of the result, so its messages meet in one task, as any other way to
    write it as one text would need.
    """
    clean = F.transform(
        F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")),
        lambda p: F.struct(
            F.when(p["type"].isin(*KINDS), p["type"]).otherwise("text").alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0).cast("long")).alias("tokens")
        ),
    )
    m = messages.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), clean.alias("parts")).alias("m"))
    g = m.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    # attachments of all turns, numbered in order
    files = F.flatten(F.transform("ms", lambda x: F.transform(F.filter(x["parts"], lambda p: p["type"] != "text"), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), x["turn"].alias("turn")))))
    g = g.withColumn("files", files)
    g = g.withColumn("attachments", F.transform("files", lambda f, k: F.struct(k.alias("k"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"), f["turn"].alias("turn"))))
    # how many attachments stand before each turn
    count = lambda x: F.size(F.filter(x["parts"], lambda p: p["type"] != "text"))
    before = F.aggregate("ms", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + count(x))))
    g = g.withColumn("before", before)

    def visited(x: Column, i: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.get("before", i).alias("k"))
        step = lambda acc, p: F.when(p["type"] == "text", F.struct(F.concat(acc["text"], escape(p["text"])).alias("text"), acc["k"].alias("k"))).otherwise(
            F.struct(F.concat(acc["text"], F.lit("<|"), p["type"], F.lit(":"), acc["k"].cast("string"), F.lit("|>")).alias("text"), (acc["k"] + 1).alias("k"))
        )
        return F.aggregate(x["parts"], start, step, lambda acc: acc["text"])

    g = g.withColumn("turns", F.transform("ms", lambda x, i: F.struct(x["role"].alias("role"), F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), visited(x, i).alias("body"))))
    g = g.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
    lens = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    texts = F.flatten(F.transform("ms", lambda x: F.filter(x["parts"], lambda p: p["type"] == "text")))
    expanded = F.aggregate(texts, F.lit(0).cast("long"), lambda a, p: a + words(p["text"])) + F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["tokens"])
    return g.select(F.col("conv").alias(conv_col), "formatted", F.size("ms").cast("long").alias("n_turns"), lens.alias("loss_spans"), "attachments", expanded.alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay as they are written."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n.*$"
    role = lambda p: F.regexp_extract(p, head, 1)
    body = lambda p: F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
