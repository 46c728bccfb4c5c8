"""A filter of fixed size: which of 2**bits slots the keys of a table fall into.

It holds 2**bits bits however many keys there are, so it may be broadcast. Keys
that share a slot with a listed key pass too; what follows must be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB.
BITS = 26
_PAGE = 15


def _slot(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def build_bitmap(keys: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """Pages (page int, words array<bigint>) with one bit for each slot in use; at most 2**bits / 8 bytes in all."""
    slot = keys.select(_slot([F.col(c) for c in columns], bits).alias("slot"))
    words = slot.selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, cast(slot % 64 AS int)) AS bit")
    # A zero for each word, so that a page's words are all there and need only be put in order.
    zeros = keys.sparkSession.range(1 << bits - 6).selectExpr("id AS word", "0L AS bit")
    used = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).unionByName(zeros).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return (
        used.groupBy(F.shiftright("word", _PAGE - 6).cast("int").alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("word", "bit"))).alias("w"))
        .select("page", F.col("w.bit").alias("words"))
    )


def keep_listed(df: DataFrame, bitmap: DataFrame, columns: list[Column], bits: int = BITS, outer: str | None = None) -> DataFrame:
    """The rows of df whose key's slot is in use: all rows with listed keys and a few others.

    With ``outer``, all rows stay and a boolean column of that name tells.
    """
    names = df.columns
    pages = bitmap.select(F.col("page").alias("_page"), F.col("words").alias("_words"))
    joined = df.withColumn("_slot", _slot(columns, bits)).withColumn("_page", F.shiftright("_slot", _PAGE).cast("int"))
    joined = joined.join(F.broadcast(pages), "_page", "left" if outer else "inner")
    hit = F.expr(f"getbit(_words[cast(shiftright(_slot, 6) % {1 << _PAGE - 6} AS int)], cast(_slot % 64 AS int)) = 1")
    if outer:
        return joined.select(*names, F.coalesce(hit, F.lit(False)).alias(outer))
    return joined.where(hit).select(*names)
