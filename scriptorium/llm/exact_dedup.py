"""Exact duplicates by progressive refinement: length, then prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import build_bitmap, keep_listed
from .workdir import discard, materialize

#: Only runs that aren't one space already have to be rewritten.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def exact_dedup(docs: DataFrame, prefix: int = 256, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text, ...).

    Texts are equal if identical after ``normalized``. The first pass keeps three
    numbers a row; rows whose length is shared, then whose (length, prefix hash)
    is shared, survive, and only their full content is read and hashed in the
    second pass. Survivors are found there by a bitmap of fixed size, so no text
    is shuffled; a row that passes it by chance costs one more hash.
    text_sha256 is null for rows that no step had to hash, unless ``hash_all``.

    Null and empty texts are equal to each other. The row with the smallest doc_id
    stays; null doc_ids come last, so a null keep_id means that no row of the
    group has an id. Rows that repeat the kept doc_id count in group_size and are
    all marked kept: they can't be told apart by id. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text").cast("string")).alias("norm"))
    sized = materialize(
        rows.select(F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")), "sizes"
    )
    by_length = sized.groupBy("length").agg(F.count("*").alias("n")).where("n > 1")
    by_head = (
        sized.groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1").join(by_length.select("length"), "length", "left_semi")
    )
    bitmap = materialize(build_bitmap(by_head, ["length", "head"]), "survivors")
    discard(sized)

    keys = [F.length("norm"), F.xxhash64(F.substring("norm", 1, prefix))]
    tagged = rows.select("doc_id", "norm", keys[0].alias("length"), keys[1].alias("head"))
    hashed = keep_listed(tagged, bitmap, [F.col("length"), F.col("head")], outer="survives").select(
        "doc_id", F.when(F.col("survives") | F.lit(hash_all), F.sha2("norm", 256)).alias("text_sha256"), "survives"
    )
    hashed = materialize(hashed, "hashes")
    groups = hashed.where("survives").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # The hash of a group may be hot. As a table, groups have an exchange of their own, without which adaptive execution can't split the join.
    groups = materialize(groups, "groups")
    joined = hashed.join(groups, "text_sha256", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
