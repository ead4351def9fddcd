"""Preference formatting: one prompt for two conversations and their masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|{}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _role(t: Column) -> Column:
    return F.coalesce(t["role"], F.lit(""))


def _body(t: Column) -> Column:
    return F.coalesce(t["text"], F.lit(""))


def _head(t: Column) -> Column:
    before, after = START.split("{}")
    return F.concat(F.lit(before), _role(t), F.lit(after))


def render(turns: Column) -> Column:
    """Turns (structs with role and text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) code points in render(turns) that are trained on: what the assistant says, its end mark included."""
    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(_head(t))
        end = start + F.char_length(_body(t)) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(_role(t) == TRAINED_ROLE, span).otherwise(none)).alias("spans"))

    return F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), step, lambda acc: acc["spans"]
    )


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``key, turns``: the turns of each conversation in order; equal numbers are put in order of role and text.

    Rows without a key are left out.
    """
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    ).alias("turns"))


def preference_format(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``pairs(key, chosen, rejected)``, arrays of turns -> one row per pair.

    The longest common turn prefix (role and text equal; NULL equals NULL) is rendered
    once as ``prompt``; the rest of either side is ``chosen`` and ``rejected``, each with
    the spans that count for the loss.  ``n_common`` turns are shared.  Sides that are
    equal have empty completions; a NULL side counts as no turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    df = df.withColumn("n_common", F.when(first > 0, first - 1).otherwise(shorter).cast("long"))
    rest = lambda c: F.slice(c, (F.col("n_common") + 1).cast("int"), F.size(c))
    df = df.select(
        key, "n_common", render(F.slice("c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r")
    )
    return df.select(
        key, "n_common", "prompt", render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c")).alias("chosen_spans"), loss_spans(F.col("r")).alias("rejected_spans"),
    )


def swapped_replies(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs for every conversation: itself, and itself with its last assistant turn taken from its neighbour.

    Keys are integers.  Neighbours are the keys 2n and 2n + 1; a conversation whose
    neighbour is missing, or where either has no assistant turn, gives no pair; see
    next_replies() for pairs of all conversations.  Rows without a key are left out.
    """
    all_ = conversations(turns, key).select(key, "turns", _last("turns").alias("last")).where("last > 0")
    reply = all_.select(F.col(key).bitwiseXOR(F.lit(1)).alias(key), F.element_at("turns", F.col("last")).alias("reply"))
    return all_.join(reply, key).select(
        F.col(key).alias("pair_id"), F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array("reply")).alias("rejected"),
    )


#: Leading hexadecimal digits of the hash by which conversations are put in a ring: at most 4,096 stretches of it.
RING_DIGITS = 3


def next_replies(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs for every conversation, whatever the type of its key: itself, and itself with its last assistant turn
    taken from the next conversation that has one, in a ring by the MD5 of the key.

    A conversation without an assistant turn is its own rejected side, and so is one that
    is the only one with such a turn; rows without a key are left out; an empty table
    gives no pairs.  The ring is put together from stretches, so no task orders it all.
    """
    all_ = conversations(turns, key).select(F.col(key).alias("pair_id"), "turns", _last("turns").alias("last"), F.md5(F.col(key).cast("string")).alias("h"))
    all_ = all_.withColumn("stretch", F.substring("h", 1, RING_DIGITS))
    usable = all_.where("last > 0").withColumn("reply", F.element_at("turns", F.col("last")))
    heads = usable.groupBy("stretch").agg(F.min_by("reply", F.struct("h", "pair_id")).alias("head"))
    along = Window.partitionBy().orderBy("stretch")  # of at most 16 ** RING_DIGITS rows
    after = F.coalesce(F.lead("head").over(along), F.first("head").over(along))
    ring = usable.withColumn("next", F.lead("reply").over(Window.partitionBy("stretch").orderBy("h", "pair_id")))
    ring = ring.join(heads.select("stretch", after.alias("after")), "stretch").select(
        "pair_id", F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(F.coalesce("next", "after"))).alias("rejected"),
    )
    return ring.union(all_.where("last = 0").select("pair_id", "turns", "turns"))


def _last(turns: str) -> Column:
    """The place, from 1, of the last assistant turn; 0 for none."""
    marks = F.transform(turns, lambda t, i: F.when(_role(t) == TRAINED_ROLE, i + 1).otherwise(0))
    return F.coalesce(F.array_max(marks), F.lit(0))
