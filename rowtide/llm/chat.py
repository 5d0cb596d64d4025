"""Preference formatting: common turns rendered once as prompt, the rest as two masked completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.operators.snapshot import with_rank

# The marks of the ChatML layout.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of a conversation in order, as array<struct<role, text>>.

    Turns are ordered by number, equal numbers by role and text; a null role counts as ``user`` and a null text
    as empty. One conversation is one output row and is gathered as such; rows without a conversation id
    belong to no conversation and form none.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(turn))
    return (
        conversations.filter("conv_id IS NOT NULL")
        .groupBy("conv_id")
        .agg(ordered.alias("ordered"))
        .select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shared = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, F.lit(1), shared), F.slice(rejected, F.lit(1), shared), lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference > 0, first_difference - 1).otherwise(shared).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END))), ""
    )


def learned_spans(prompt: Column, turns: Column) -> Column:
    """Spans of prompt + completion that carry loss: text and end mark of the completion's assistant turns.

    ``start:end`` in code points, comma-joined; the end mark's newline is not learned.
    """
    first = F.struct(F.length(prompt).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state, turn):
        start = state["at"] + F.length(turn["role"]) + len(TURN_START) + 1
        end = start + F.length(turn["text"]) + len(TURN_END) - 1
        span = F.when(turn["role"] == "assistant", F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], span).alias("spans"))

    return F.aggregate(turns, first, step, lambda state: F.array_join(state["spans"], ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Render pairs of conversations (pair_id, chosen, rejected: arrays of role and text).

    Returns (pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans). The prompt is
    the longest common turn prefix, rendered once; ``chosen`` and ``rejected`` are the rendered turns after
    it. Equal conversations have empty completions; a null conversation counts as one without turns. Pairs
    are formatted row by row, so repeated pairs stay; other columns are dropped.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    cut = sides.withColumn("k", common_turns(F.col("c"), F.col("r")))
    after = lambda side: F.slice(side, F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))
    parts = cut.select(
        "pair_id", "k", rendered(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"), after(F.col("c")).alias("c"), after(F.col("r")).alias("r")
    )
    return parts.select(
        "pair_id",
        F.col("k").alias("n_prompt_turns"),
        "prompt",
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        learned_spans(F.col("prompt"), F.col("c")).alias("chosen_spans"),
        learned_spans(F.col("prompt"), F.col("r")).alias("rejected_spans"),
    )


def up_to_last_reply(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen): each conversation that has an assistant turn, up to the last one."""
    whole = turns_of(conversations)
    backwards = F.transform(F.reverse("turns"), lambda t: t["role"])
    from_end = F.array_position(backwards, "assistant").cast("int")
    cut = whole.withColumn("last", F.when(from_end > 0, F.size("turns") - from_end + 1)).filter("last IS NOT NULL")
    return cut.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"))


def exchanged(cut: DataFrame, replies: DataFrame, on: str) -> DataFrame:
    """(pair_id, chosen, rejected): the last reply exchanged for ``other`` of the joined row, or left out without one."""
    before = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    none = F.array().cast("array<struct<role:string,text:string>>")
    return cut.join(replies, on, "left").select(
        F.col("conv_id").alias("pair_id"), "chosen", F.concat(before, F.coalesce("other", none)).alias("rejected")
    )


def next_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs by the order of ids: (pair_id, chosen, rejected).

    Chosen is a conversation up to its last assistant turn. Rejected is the same conversation with that reply exchanged
    for the last reply of the next conversation, in id order, that has one; the last takes the first one's. Ids may
    be sparse and of any ordered type. Only a table with a single reply leaves it out of the rejected side.
    Conversations without an assistant turn form no pair.
    """
    cut = up_to_last_reply(conversations)
    # Only ids are ranked and written; the turns stay in the plan.
    ids = conversations.filter("conv_id IS NOT NULL AND role = 'assistant'").select("conv_id").distinct()
    ranked = with_rank(ids, ["conv_id"])
    after = ranked.filter("n_total > 1").select(
        F.pmod(F.col("row_rank") - 1, "n_total").alias("row_rank"), F.col("conv_id").alias("next_id")
    )
    following = ranked.join(after, "row_rank").select("conv_id", "next_id")
    replies = cut.select(F.col("conv_id").alias("next_id"), F.slice("chosen", -1, 1).alias("other"))
    return exchanged(cut.join(following, "conv_id", "left"), replies, "next_id")
