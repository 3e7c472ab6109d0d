"""Collapse of cumulative snapshots of conversations, then rendering.

A chat service logs a conversation again after each turn, so most logged conversations are prefixes of longer ones. Each turn gets
a rolling prefix hash of 128 bits: the hash before it xor the hash of (position, role, text). A conversation goes if its last
hash is a prefix hash of a longer one; of conversations that are equal throughout, the smallest conv_id stays. What is left is
rendered.

No conversation is one group: turns are taken in blocks of ``block`` turn numbers, positions and hashes are summed within a block, and
block totals are summed over the (few) blocks of a conversation. Text is rendered in parts of ``block`` turns. Prefix hashes
are made distinct before the anti-join, so a first turn that a third of all conversations share is one row per task.

Defined results: turns are ordered by (turn, role, MD5 of text), nulls first. Rows equal in conv_id, turn, role and text count once.
A null role is "" and a null text is the empty text. A null conv_id is one conversation of its own. Markers ``<|`` inside a role or text
are broken by a space, so that a text can't forge a turn. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import pick, written

BLOCK = 256


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, turn, role, digest, pos, hi, lo``: place in the conversation from 1 and prefix hash at each distinct turn."""
    slim = (
        turns.select("conv_id", "turn", "role", F.md5("text").alias("digest"))
        .distinct()
        .withColumn("block", F.floor(F.col("turn") / block))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(
        F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")
    )
    # The place within the block is part of what is hashed; the block's own place is added with its offset below.
    placed = slim.withColumn("place", F.row_number().over(inside).cast("long"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("conv_id", "block")
        .agg(F.max("place").alias("n"))
        .select(
            F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    numbered = placed.join(starts, same).withColumn("pos", F.col("start") + F.col("place"))
    hashed = numbered.withColumns(
        {
            "own_hi": F.xxhash64("pos", "role", "digest"),
            "own_lo": F.xxhash64("digest", "pos", F.lit("low"), "role"),
        }
    )
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = hashed.withColumns({"in_hi": F.bit_xor("own_hi").over(running), "in_lo": F.bit_xor("own_lo").over(running)})
    totals = (
        hashed.groupBy("conv_id", "block")
        .agg(F.bit_xor("own_hi").alias("t_hi"), F.bit_xor("own_lo").alias("t_lo"))
        .select(
            F.col("conv_id").alias("c"),
            F.col("block").alias("b"),
            F.coalesce(F.bit_xor("t_hi").over(before), F.lit(0)).alias("b_hi"),
            F.coalesce(F.bit_xor("t_lo").over(before), F.lit(0)).alias("b_lo"),
        )
    )
    return within.drop("c", "b").join(totals, same).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "pos",
        F.col("in_hi").bitwiseXOR(F.col("b_hi")).alias("hi"),
        F.col("in_lo").bitwiseXOR(F.col("b_lo")).alias("lo"),
    )


def maximal(placed: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_equal``: conversations that no other one extends, once for each content."""
    last = placed.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    ends = (
        placed.join(last.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("n_turns")))
        .groupBy("hi", "lo", "n_turns")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    )
    prefixes = (
        placed.join(last.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") < F.col("n_turns")))
        .select("hi", "lo", F.col("pos").alias("n_turns"))
        .distinct()
    )
    return ends.join(prefixes, ["hi", "lo", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_equal")


def rendered(role: Column, text: Column) -> Column:
    def safe(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def collapse_and_render(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """``conv_id, part, n_turns, n_equal, rendered``: maximal conversations, in parts of ``block`` turns.

    ``n_equal`` counts the logged conversations with just these turns. The parts of a conversation in order, put together, are
    its whole text.
    """
    given = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    turns = given.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    # Read three times below, so written once: hashes and places alone.
    placed = written(positions(turns, block), "chat-positions")
    kept = maximal(placed).withColumnRenamed("conv_id", "c")
    chosen = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), F.col("role").alias("k_role"),
        F.col("digest").alias("k_digest"), "pos", "n_turns", "n_equal",
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("k_conv"))
        & F.col("turn").eqNullSafe(F.col("k_turn"))
        & (F.col("role") == F.col("k_role"))
        & (F.md5("text") == F.col("k_digest"))
    )
    part = F.floor((F.col("pos") - 1) / block).cast("long")
    return (
        turns.join(chosen, same)
        .select("conv_id", part.alias("part"), "pos", "n_turns", "n_equal", rendered(F.col("role"), F.col("text")).alias("piece"))
        # Repeated rows have one place. A list holds one part.
        .groupBy("conv_id", "part", "n_turns", "n_equal")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "piece"))).alias("pieces"))
        .select("conv_id", "part", "n_turns", "n_equal", F.expr("array_join(transform(pieces, p -> p.piece), '')").alias("rendered"))
    )


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(role || chr(31) || md5(text), chr(30)) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), ends AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM n WHERE pos = n_turns GROUP BY prefix
), kept AS (
  SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM n WHERE pos < n_turns)
)
SELECT n.conv_id, (n.pos - 1) // 256 AS part, n.n_turns, k.n_equal,
       string_agg('<|im_start|>' || replace(n.role, '<|', '< |') || chr(10) || replace(n.text, '<|', '< |')
                  || '<|im_end|>' || chr(10), '' ORDER BY n.pos) AS rendered
FROM n JOIN kept k ON n.conv_id = k.conv_id
GROUP BY ALL
"""
