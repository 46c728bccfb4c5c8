"""Benchmark passages inside documents by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` consecutive words. A document holds
a window only if it holds all of the window's words, so by the prefix filter for
full containment the one rarest word of a window has to be joined: the windows
are indexed by it, rarity being the number of times a word occurs in all
documents. Documents' words meet the index's words by themselves, without their
texts. Documents with such words are read again: the words around each place
meet the index, the positional bound drops places where the window would reach
over an end of the document, and the item-sized run is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import build_bitmap, keep_listed
from .workdir import discard, materialize

#: Largest window index (in bytes of its words) that is broadcast; beyond it the index is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: What separates words, as a character class over A-Z, a-z, 0-9 and all that isn't ASCII.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text as they are written; an empty array for null."""
    # Only the ends of a split can be empty.
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, w array<string>) for each distinct window of each item."""
    words = items.select("item_id", words_of(ascii_lower(F.col("text").cast("string"))).alias("words")).where("size(words) > 0")
    starts = F.explode(F.expr(f"sequence(1, greatest(1, size(words) - {window} + 1))"))
    return words.select("item_id", "words", starts.alias("at")).select("item_id", F.slice("words", F.col("at"), window).alias("w")).distinct()


def word_lower(word: Column) -> Column:
    """ascii_lower of one word; lower() does the same to a word that is all ASCII, and sooner."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(ascii_lower(word))


def window_index(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(token, at, w, item_ids): each distinct window under its rarest word; at is that word's place in it, from 1."""
    windows = _windows(items, window).groupBy("w").agg(F.collect_set("item_id").alias("item_ids"))
    numbered = materialize(windows.withColumn("window_id", F.sha2(F.array_join("w", " "), 256)), "windows")
    places = numbered.select("window_id", F.posexplode("w").alias("at", "token"))
    vocabulary = materialize(places.select("token").distinct(), "vocabulary")
    seen = docs.select(F.explode(words_of(F.col("text").cast("string"))).alias("word")).select(word_lower(F.col("word")).alias("token"))
    counts = _join_small(seen, vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "token", "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token", "at")).alias("best"))
    index = numbered.join(ranked, "window_id").select("best.token", (F.col("best.at") + 1).alias("at"), "w", "item_ids")
    out = materialize(index, "index")
    discard(numbered, vocabulary)
    return out


def _small(table: DataFrame) -> bool:
    """Whether the table's strings fit the bound of a broadcast."""
    size = F.sum(F.length(F.to_json(F.struct(*table.columns))))
    return (table.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def _join_small(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """big with the rows of small: by broadcast if it is small, else by shuffle of the rows that a filter of fixed size lets pass."""
    if _small(small):
        return big.join(F.broadcast(small), key)
    return keep_listed(big, build_bitmap(small.select(key), [key]), [F.col(key)]).join(small, key)


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, at, size, item_ids: one row for each place of a window, one at least for each row of docs (nulls in the last three)."""
    index = window_index(docs, items, window).withColumn("size", F.size("w"))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("row_key", F.xxhash64("doc_id", "text"))  # equal rows have equal places
    token = text.select("row_key", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).select("row_key", "pos", word_lower(F.col("word")).alias("token"))
    rare = materialize(index.select("token").distinct(), "tokens")
    # A document's places, at most as many as it has words, in one row.
    places = materialize(_join_small(token, rare, "token").groupBy("row_key").agg(F.collect_set("pos").alias("places")), "places")
    n_words = F.size("words").cast("long").alias("n_words")
    every = text.select("doc_id", words_of(F.col("text")).alias("words")).select("doc_id", n_words)
    listed = keep_listed(text, build_bitmap(places, ["row_key"]), [F.col("row_key")]).join(places, "row_key")
    # The words around a place, so that what is joined doesn't carry its text.
    first = lambda p: F.greatest(p - (window - 1), F.lit(0))
    around = lambda p: F.struct(p.alias("pos"), F.slice("words", first(p) + 1, p - first(p) + window).alias("near"))
    near = listed.select("doc_id", "places", words_of(F.col("text")).alias("words")).select("doc_id", n_words, F.explode(F.transform("places", around)).alias("x"))
    near = near.select("doc_id", "n_words", "x.pos", F.transform("x.near", word_lower).alias("near")).withColumn("mine", F.least("pos", F.lit(window - 1)))
    met = _join_small(near.withColumn("token", F.element_at("near", F.col("mine") + 1)), index, "token")
    begin = F.col("pos") - F.col("at") + 2
    fits = (begin >= 1) & (begin + F.col("size") - 1 <= F.col("n_words"))
    run = F.slice("near", F.greatest(F.col("mine") - F.col("at") + 2, F.lit(1)), F.col("size"))
    hits = met.where(fits & (run == F.col("w"))).select("doc_id", "n_words", begin.alias("at"), "size", "item_ids")
    return every.select("doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("size", "int"), ("item_ids", hits.schema["item_ids"].dataType))]).unionByName(hits)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each doc_id of docs(doc_id, text, ...).

    A-Z count as a-z; words are runs of ASCII letters and digits and of characters
    beyond ASCII. n_hit counts the words that lie inside an occurrence of a window,
    n_items the items with an occurring window; items_sha256 is the SHA-256 of
    their ids, sorted as strings and joined by commas (of the empty string if none).

    Null and empty texts have no words and no hits, and neither do items without
    words; items whose id is null count as one item without an id in the digest.
    Equal windows of several items count for each. Rows that repeat a doc_id are
    taken together as one row: the largest n_words, the union of their hits. Other
    columns are ignored, empty tables of either kind are allowed.
    """
    places = find_windows(docs, items, window)
    found = places.select("doc_id", "n_words", "item_ids", F.explode_outer(F.when(F.col("at").isNotNull(), F.expr("sequence(at, at + size - 1)"))).alias("word"))
    # Distinct words and distinct items of a document, each pre-aggregated before the shuffle.
    words = found.groupBy("doc_id", "word").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("item_ids")).alias("ids"))
    per_doc = words.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.count("word").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set(F.array_distinct("ids")))).alias("ids"),
    )
    names = F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",")
    return per_doc.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw), dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT dw.doc_id, bw.item_id, i, dw.size FROM dw JOIN bw ON dw.run = bw.run AND dw.size = bw.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
