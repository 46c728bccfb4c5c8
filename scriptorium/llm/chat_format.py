"""Chat transcripts: collapse of cumulative snapshots, then rendering; DataFrame operations only.

A logged conversation that another one continues repeats its turns. Each prefix
of a conversation has a rolling hash, the exclusive-or of hashes of (place, role,
text); a conversation whose full hash is a prefix hash of a longer one is a
snapshot of it. An anti-join keeps the maximal conversations, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workdir import materialize

#: The chat template's marks.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
#: Turns of one part of a conversation: no task has to hold more rows of it together.
PART = 1024


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "role", "text")


def prefix_hashes(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, place (1, 2, ...), role, text, h1, h2 (hashes of the prefix that ends with the turn).

    A long conversation is split into parts by its turn numbers; places and hashes
    run within a part, and each part adds what the parts before it sum up to.
    """
    rows = (
        turns.where("conv_id IS NOT NULL")
        .select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .distinct()
        .withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit((1 << 62))))
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    local = materialize(rows.withColumn("place", F.row_number().over(inside).cast("long")), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv_id", "part", "skipped")
    placed = local.join(sizes, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("skipped")).withColumn("a", _hash(1)).withColumn("b", _hash(2))
    sums = placed.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    sums = sums.select("conv_id", "part", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"))
    run = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.withColumn("a", F.bit_xor("a").over(run)).withColumn("b", F.bit_xor("b").over(run)).join(sums, ["conv_id", "part"])
    return hashed.select(
        "conv_id", "part", "place", "role", "text", F.col("a").bitwiseXOR(F.col("a0")).alias("h1"), F.col("b").bitwiseXOR(F.col("b0")).alias("h2")
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that none continues; of equal ones the smallest conv_id."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max(F.struct("place", "h1", "h2")).alias("end"))
    sizes = materialize(sizes.select("conv_id", "n_turns", F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2")), "conversations")
    leaders = sizes.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # Many conversations begin alike: prefixes are made distinct (and summed before the shuffle) first.
    proper = (
        prefixes.select("conv_id", "place", "h1", "h2").join(sizes.select("conv_id", "n_turns"), "conv_id").where("place < n_turns")
        .select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    )
    return leaders.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def rendered_turn(role: Column, text: Column) -> Column:
    """A turn between the marks; marks inside a text lose their bar, so a text can't forge a turn."""
    safe = F.replace(text, F.lit("<|"), F.lit("<"))
    return F.concat(F.lit(TURN_START), F.replace(role, F.lit("<|"), F.lit("<")), F.lit("\n"), safe, F.lit(TURN_END + "\n"))


def format_chats(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, n_turns, rendered: each maximal conversation of turns(conv_id, turn, role, text, ...), in parts.

    Turns are ordered by turn, then role and text; a null turn comes last; null role
    and text are empty. Rows that repeat a turn in full count once. Rows without
    conv_id are no conversation. Conversations of equal turns collapse to the
    smallest conv_id, and those whose turns begin another's go. ``part`` counts
    from 0 by turn numbers (1024 a part), so that a conversation of any length is
    never gathered in one row; the parts in order make the whole. Other columns are
    ignored; an empty table gives an empty result.
    """
    prefixes = materialize(prefix_hashes(turns, part), "prefixes")
    kept = maximal_conversations(prefixes)
    rows = prefixes.join(kept, "conv_id").select("conv_id", "n_turns", "part", "place", rendered_turn(F.col("role"), F.col("text")).alias("piece"))
    pieces = rows.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    order = Window.partitionBy("conv_id").orderBy("part")
    return pieces.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("part"), "n_turns", F.array_join(F.col("p.piece"), "").alias("rendered")
    )


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM t),
h AS (
  SELECT *, string_agg(md5(role || chr(1) || text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain,
    max(place) OVER (PARTITION BY conv_id) AS n_turns FROM n
),
ends AS (SELECT chain, min(conv_id) AS conv_id FROM h WHERE place = n_turns GROUP BY chain),
kept AS (SELECT conv_id FROM ends WHERE chain NOT IN (SELECT chain FROM h WHERE place < n_turns))
SELECT conv_id, (dense_rank() OVER (PARTITION BY conv_id ORDER BY p) - 1)::BIGINT AS part, n_turns, rendered FROM (
  SELECT conv_id, coalesce(turn // 1024, 4611686018427387904) AS p, n_turns,
    string_agg('<|im_start|>' || replace(role, '<|', '<') || chr(10) || replace(text, '<|', '<') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM h WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, p, n_turns)
"""
