"""Preference formatting, in DataFrame expressions only.

A pair is a chosen and a rejected conversation. The turns that both begin with are rendered once, as
the prompt; what follows is rendered for each side as a completion, with the ranges of characters that
a loss is taken on: assistant turns with their end marks, not what others say in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.shared import written

#: A turn is BEFORE, its role, AFTER_ROLE, its text, END.
BEFORE, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def turns_of(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", into: str = "turns") -> DataFrame:
    """(pair, ``into``): each conversation's turns in order, as array<struct<turn, role, text>>.

    Rows with a null conversation belong to none; null roles and texts count as empty; equal turn
    numbers follow in order of role and text, null ones come first; repeated rows are turns each."""
    of = F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = conversations.filter(F.col(f"`{conversation}`").isNotNull()).select(F.col(f"`{conversation}`").alias("pair"), of.alias("t"))
    return rows.groupBy("pair").agg(F.array_sort(F.collect_list("t")).alias(into))


def common_prefix(left: str, right: str) -> Column:
    """Number of turns, by role and text, that both arrays begin with."""
    both = F.expr(f"sequence(1, least(size({left}), size({right})))")
    both = F.when(F.least(F.size(left), F.size(right)) > 0, both).otherwise(F.array().cast("array<int>"))
    differ = F.filter(both, lambda i: (F.get(left, i - 1)["role"] != F.get(right, i - 1)["role"]) | (F.get(left, i - 1)["text"] != F.get(right, i - 1)["text"]))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, F.least(F.size(left), F.size(right))).cast("int")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEFORE), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def trained_ranges(turns: Column) -> Column:
    """array<struct<start, stop>>: character ranges of the rendered turns that a loss is taken on."""
    head = lambda t: F.length(t["role"]) + len(BEFORE) + len(AFTER_ROLE)
    whole = lambda t: head(t) + F.length(t["text"]) + len(END)
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("ranges"))

    def step(done: Column, t: Column) -> Column:
        stop = done["at"] + whole(t)
        new = F.array(F.struct((done["at"] + head(t)).cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct(stop.cast("long").alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(done["ranges"], new)).otherwise(done["ranges"]).alias("ranges"))

    return F.aggregate(turns, none, step, lambda done: done["ranges"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Format the pairs of two tables (pair, turns) as ``turns_of`` gives them.

    Returns a row for each pair of either table: pair; ``prompt_turns`` (int) and ``prompt``, the
    common prefix; ``chosen`` and ``rejected``, the completions; and ``chosen_trained`` and
    ``rejected_trained``, their character ranges under the loss. A side that is missing has no turns;
    a side that only repeats the prompt has an empty completion. Pairs are joined by id, one row to a
    conversation, so no pair costs more than its own turns.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = chosen.withColumnRenamed("turns", "__c").join(rejected.withColumnRenamed("turns", "__r"), "pair", "full_outer").select("pair", F.coalesce("__c", none).alias("__c"), F.coalesce("__r", none).alias("__r"))
    both = both.withColumn("prompt_turns", common_prefix("__c", "__r"))
    rest = {side: F.expr(f"slice({of}, prompt_turns + 1, size({of}))") for side, of in (("chosen", "__c"), ("rejected", "__r"))}
    cut = both.select("pair", "prompt_turns", F.expr("slice(__c, 1, prompt_turns)").alias("__p"), *(v.alias(f"__{k}") for k, v in rest.items()))
    return cut.select("pair", "prompt_turns", render(F.col("__p")).alias("prompt"), *(render(F.col(f"__{s}")).alias(s) for s in rest), *(trained_ranges(F.col(f"__{s}")).alias(f"{s}_trained") for s in rest))


def _following(ids: DataFrame) -> DataFrame:
    """(pair, next): each id with the one after it, and the last with the first; range by range, so that
    no task orders all of them."""
    placed = written(ids.repartitionByRange("pair").withColumn("part", F.spark_partition_id()), "ids")
    parts = placed.groupBy("part").agg(F.min("pair").alias("first"))  # a row a partition
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    beyond = F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = F.lead("pair").over(Window.partitionBy("part").orderBy("pair"))
    return placed.join(parts.select("part", beyond.alias("beyond")), "part").withColumn("own", own).select("pair", F.coalesce("own", "beyond").alias("next"))


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations made of a table (pair, turns).

    Chosen is every conversation up to its last assistant turn; rejected is the same with that turn's
    text taken from the last assistant turn of the conversation that comes next in order of the id, of
    those that have one (after the last comes the first). A conversation without assistant turns stands
    unchanged on both sides, and so do both sides where only one conversation has one.
    """
    numbered = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i + 1).otherwise(0)), lambda i: i > 0)
    known = turns.filter(F.size("turns") > 0).withColumn("at", F.coalesce(F.array_max(numbered), F.lit(0)))
    chosen = known.select("pair", F.when(F.col("at") > 0, F.expr("slice(turns, 1, at)")).otherwise(F.col("turns")).alias("turns"))
    replies = known.filter("at > 0").select(F.col("pair").alias("next"), F.expr("element_at(turns, at).text").alias("reply"))
    joined = known.join(_following(known.filter("at > 0").select("pair")).join(replies, "next").select("pair", "reply"), "pair", "left")
    swapped = F.expr("concat(slice(turns, 1, at - 1), array(named_struct('turn', element_at(turns, at).turn, 'role', element_at(turns, at).role, 'text', reply)))")
    rejected = joined.select("pair", F.when(F.col("at") > 0, swapped).otherwise(F.col("turns")).alias("turns"))
    return chosen, rejected
