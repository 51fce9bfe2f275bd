"""Preference pairs for training: the common turns are the prompt, each side's own turns a masked completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINED = "assistant"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as array<struct<role, text>>.

    Turns are ordered by number, equal numbers by role and text, null numbers first. Null roles and texts count as
    empty. Rows without a conv_id are left out. One conversation is one row: its length, not the table's, bounds it.
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    return (
        turns.where("conv_id is not null").groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", role, text))).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def branched_replies(conversations: DataFrame, group: int = 1000) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation against itself with another one's turns from one of its replies on.

    Of its n replies a conversation branches at the one numbered conv_id modulo n, from 0; what stands there and after it is
    its tail. The rejected side is what precedes the tail, with the tail of the next conversation by conv_id, the first for
    the last, among each ``group`` of consecutive ids. So both sides go on over turns of users, and pairs part at all depths.

    A conversation without a reply branches at its end: its tail is empty. One alone in its group meets its own tail, and
    both sides are equal. Equal conv_ids are not expected; they give a pair each, in no fixed order. An empty table gives none.
    """
    order = Window.partitionBy(F.floor(F.col("conv_id") / group)).orderBy("conv_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = F.filter(F.sequence(F.lit(0), F.size("turns")), lambda i: F.get("turns", i)["role"] == TRAINED)
    # the number of turns before the branch
    before = F.coalesce(F.get("_at", F.pmod("conv_id", F.nullif(F.size("_at"), F.lit(0))).cast("int")), F.size("turns"))
    cut = conversations.withColumn("_at", places).withColumn("_before", before)
    tail = F.slice("turns", F.col("_before") + 1, F.size("turns") - F.col("_before"))
    met = cut.withColumn("_tail", tail).withColumn("_other", F.coalesce(F.lead("_tail").over(order), F.first("_tail").over(whole)))
    return met.select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_before")), "_other").alias("rejected")
    )


def rendered(turn: Column) -> Column:
    """A turn as text: its role in a marker, its text, an end marker."""
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>"), turn["text"], F.lit("<|end|>\n"))


def spans(turns: Column) -> Column:
    """Where the loss counts in the rendered turns: from after the role's marker to the end of trained turns, as
    array<struct<start, end>> in characters."""
    length = lambda t: F.char_length(rendered(t)).cast("long")
    state = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found")),
        lambda s, t: F.struct(
            (s["at"] + length(t)).alias("at"),
            F.when(t["role"] == TRAINED, F.array_append(s["found"], F.struct((s["at"] + F.char_length(t["role"]) + 4).alias("start"), (s["at"] + length(t)).alias("end"))))
            .otherwise(s["found"]).alias("found"),
        ),
    )
    return state["found"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs (pair_id, chosen, rejected).

    Both sides are array<struct<role, text>>. Their longest common run of turns from the start is rendered once as the
    prompt; what follows on each side is that side's completion. A mask lists the spans of a completion on which the
    loss counts, those of assistant turns; users' turns in a completion are masked out.

    A side that is null counts as no turns. If one side begins the other, its completion is empty and so is its mask;
    two equal sides have two empty completions. Without a common turn the prompt is empty. Repeated rows give repeated
    rows, a null pair_id stays null, an empty table gives none. Other columns are not read.
    """
    turns = "array<struct<role:string,text:string>>"
    sides = pairs.select("pair_id", *(F.coalesce(F.col(c), F.array().cast(turns)).alias(c) for c in ("chosen", "rejected")))
    differ = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: F.equal_null(a, b)), False).cast("int")
    common = sides.withColumn("n_common", F.when(differ == 0, F.size("chosen")).otherwise(differ - 1))
    join = lambda c: F.array_join(F.transform(c, rendered), "")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    cut = common.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(
        "pair_id", "n_common", join("prompt").alias("prompt"), join("chosen").alias("chosen"), join("rejected").alias("rejected"),
        spans(F.col("chosen")).alias("chosen_mask"), spans(F.col("rejected")).alias("rejected_mask"),
    )
