"""Operator 6: preference formatting of conversations.

For a pair of conversations - chosen and rejected - the longest common prefix of turns is found (equal role and text),
rendered once as the prompt, and each side's remaining turns are rendered as a completion whose mask marks the characters
that a loss covers: those of assistant turns' texts with their end marks.

Turn rows: (conv_id, turn, role, text), a null role or text counts as empty. Turns are ordered by turn, role, text; nulls
first; repeated rows are repeated turns. A conversation without turns, or a side that isn't there, is an empty one: the
prefix is then empty. Turns of a null conv_id belong to no conversation, and are left out. Identical sides have two empty completions, ``status`` says so. All turns of a conversation come
together in one row, as its rendering is one text; conversations of one content or one opening share no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (array of role, text, in order)."""
    clean = turns.where("conv_id is not null").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    ordered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))))


def loss_spans(turns: Column) -> Column:
    """Character ranges (begin, end) of a rendering that a loss covers."""
    head, tail = len(START) + 1, len(END)

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + head + F.char_length(t["role"])
        end = begin + F.char_length(t["text"]) + tail
        span = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])


def preference(pairs: DataFrame) -> DataFrame:
    """Formats pairs (chosen, rejected: arrays of role, text; further columns are kept, but for those named as the ones added).

    Adds n_prefix, prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask (ranges within the
    completion), status: ``ok``, ``identical`` or ``one_sided`` (a side without turns).
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    pairs = pairs.withColumns({c: F.coalesce(c, none) for c in ("chosen", "rejected")})
    short = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.filter(F.sequence(F.lit(1), short), lambda i: F.element_at("chosen", i) != F.element_at("rejected", i))
    prefix = F.when(short == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, short))
    out = pairs.withColumn("n_prefix", prefix)
    rest = {c: F.slice(c, F.col("n_prefix") + 1, F.size(c)) for c in ("chosen", "rejected")}
    out = out.withColumn("prompt", rendered(F.slice("chosen", F.lit(1), F.col("n_prefix"))))
    for side, turns in rest.items():
        out = out.withColumns({f"{side}_completion": rendered(turns), f"{side}_mask": loss_spans(turns)})
    one = (F.size("chosen") == 0) | (F.size("rejected") == 0)
    status = F.when(one, "one_sided").when((F.size("chosen") == F.col("n_prefix")) & (F.size("rejected") == F.col("n_prefix")), "identical").otherwise("ok")
    return out.withColumn("status", status).drop("chosen", "rejected")


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs made of conversations alone: rejected is the conversation with its last assistant turn replaced.

    The replacement is the last assistant turn of the partner, the conversation of the same number but for the lowest bit
    (of several whose conv_id is a text of one number, the least). Without a partner that has one, or with a conv_id that
    is no whole number, rejected is empty; without an assistant turn of its own, both sides are identical.
    """
    conv = conversations(turns)
    numbered = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))
    conv = conv.withColumns({"last": F.array_max(numbered), "number": F.col("conv_id").try_cast("long")})
    reply = conv.where("last is not null and number is not null").select(F.expr("number ^ 1").alias("number"), "conv_id", F.element_at("turns", F.col("last") + 1).alias("reply"))
    if dict(turns.dtypes)["conv_id"] not in ("tinyint", "smallint", "int", "bigint"):  # otherwise a number has one conversation
        reply = reply.groupBy("number").agg(F.min_by("reply", "conv_id").alias("reply"))
    joined = conv.join(reply.drop("conv_id"), "number", "left")
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.col("reply")).otherwise(t))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).when(F.col("reply").isNotNull(), swapped)
    return joined.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
