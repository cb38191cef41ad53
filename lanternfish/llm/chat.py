"""Preference formatting of chosen and rejected conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.store import written

START, END = "<|im_start|>", "<|im_end|>"


def turns_of(rows: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", name: str = "turns") -> DataFrame:
    """(id, array of (turn, role, text)) of each conversation, in order of turn, role and text. Null roles
    and texts are empty. A conversation is one training example, so it is one row."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return rows.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(turn)).alias(name))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """A 1 for each code point of :func:`render` that is learnt (an assistant's text and the mark that ends it), else 0."""
    def one(t: Column) -> Column:
        learnt = F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.repeat(F.lit("0"), F.char_length(t["role"]) + len(START) + 1),
                        F.repeat(learnt, F.char_length(t["text"]) + len(END)), F.lit("0"))
    return F.array_join(F.transform(turns, one), "")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(__id, chosen array, rejected array) to (__id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask)."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    got = pairs.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return got.select("__id", F.col("n_common").cast("long").alias("n_common"), render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
                      *[f(rest(c)).alias(name) for c in ("chosen", "rejected") for f, name in ((render, c), (mask, f"{c}_mask"))])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) of each id that has both conversations.

    The longest common prefix of turns (equal role and text, whatever the turns' numbers) is rendered
    once, as the prompt; the rest of each conversation is its completion, with a mask of what is learnt.
    Equal conversations have empty completions. Null roles and texts are empty; turns of equal number
    come in order of role and text; repeated rows are turns of their own; null ids make no pair; empty tables give an
    empty result. A very long conversation is one row, as one example is. Other columns are not read, whatever they
    are called.
    """
    both = turns_of(chosen, id_col, turn_col, role_col, text_col, "chosen").join(turns_of(rejected, id_col, turn_col, role_col, text_col, "rejected"), "__id")
    return format_pairs(both).withColumnRenamed("__id", id_col)


def swapped_replies(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preference pairs of conversations that have no rejected side: chosen is each conversation, rejected
    is the same with its last assistant's text taken from that of the conversation whose id is one more
    (empty if there is none). A conversation without an assistant has itself on both sides. Nulls, ties, repeats and
    empty tables are as in :func:`preference_pairs`, but a conversation of a null id stays, with an empty reply; a
    very long conversation is one row, as one example is. Other columns are not read, whatever they are called."""
    held = written(turns_of(conversations, id_col, turn_col, role_col, text_col, "chosen"), "conversations")
    replies = F.filter("chosen", lambda t: t["role"] == "assistant")
    other = held.select((F.col("__id") - 1).alias("__id"), F.when(F.size(replies) > 0, F.element_at(replies, -1)["text"]).alias("reply"))
    # the place of the last assistant's turn, 0 if there is none
    place = F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(F.lit(0))))
    pairs = held.join(other, "__id", "left").withColumn("place", place)
    swapped = F.transform("chosen", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == F.col("place"), F.coalesce("reply", F.lit(""))).otherwise(t["text"]).alias("text")))
    return format_pairs(pairs.select("__id", "chosen", swapped.alias("rejected"))).withColumnRenamed("__id", id_col)
