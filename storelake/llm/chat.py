"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

A logged conversation that is a prefix of a longer logged one is a snapshot of
it. Every turn gets the rolling hash of the turns up to it; a conversation whose
last rolling hash occurs inside a longer conversation is dropped by an anti join,
and of identical conversations the smallest id stays. The maximal ones are then
rendered.

The rolling hash is a sum of per-turn hashes salted with the turn's position
(three 40-bit lanes), so it can be summed in segments: one conversation with a
third of all turns is spread over segments of ``SEGMENT`` turn numbers, each
summed on its own and shifted by the sums of the segments before it. Rendered text comes
in parts, one for each segment, so no task builds an unbounded string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 512
LANES = ("p1", "p2", "p3")
_MASK = (1 << 40) - 1


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / SEGMENT).cast("long").alias("part"),
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, p1, p2, p3): the rolling hash after each turn; ``pos`` counts from 1 to ``n``."""
    turns = _turns(conversations)
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    numbered = turns.withColumn("row", F.row_number().over(inside)).select("conv_id", "part", "row", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"))
    # row counts of the segments before this one: a few narrow rows a conversation
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    starts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).select("conv_id", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("n"))
    same = lambda x, y: x["conv_id"].eqNullSafe(y["conv_id"]) & x["part"].eqNullSafe(y["part"])
    placed = numbered.join(starts, same(numbered, starts)).select(numbered["conv_id"], numbered["part"], "row", "a", "b", (F.col("start") + F.col("row")).alias("pos"), "n")
    lane = {p: F.xxhash64(F.lit(i), "pos", "a", "b").bitwiseAND(F.lit(_MASK)) for i, p in enumerate(LANES)}
    terms = placed.select("conv_id", "part", "row", "pos", "n", *(v.alias(k) for k, v in lane.items()))
    so_far = Window.partitionBy("conv_id", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rolling = terms.select("conv_id", "part", "pos", "n", *(F.sum(p).over(so_far).alias(p) for p in LANES))
    carried = terms.groupBy("conv_id", "part").agg(*(F.sum(p).alias(p) for p in LANES)).select("conv_id", "part", *(F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"c_{p}") for p in LANES))
    return rolling.join(carried, same(rolling, carried)).select(rolling["conv_id"], "pos", "n", *((F.col(p) + F.col(f"c_{p}")).alias(p) for p in LANES))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are a prefix of no longer one."""
    hashes = prefix_hashes(conversations)
    # distinct first: a first turn that a third of all conversations share is one row a task
    inner = hashes.where(F.col("pos") < F.col("n")).select("pos", *LANES).distinct()
    ends = hashes.where(F.col("pos") == F.col("n")).groupBy("pos", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return ends.join(inner, ["pos", *LANES], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text``: the rendered maximal conversations.

    Turns are ordered by turn, role, text (nulls first); repeated rows are turns of
    their own. A null role renders as ``unknown``, a null text as empty, and rows
    without a conv_id form one conversation. ``part`` numbers segments of 512
    turn numbers (null: turns without a number). Empty input gives an empty result."""
    kept = maximal_conversations(conversations)
    turns = _turns(conversations)
    mine = turns.join(kept, turns["conv_id"].eqNullSafe(kept["conv_id"])).select(turns["conv_id"], "part", "turn", "role", "text", "n_turns", "n_copies")
    listed = mine.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    render = F.transform("said", lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n")))
    return listed.select("conv_id", "part", "n_turns", "n_copies", F.concat_ws("", render).alias("text"))
