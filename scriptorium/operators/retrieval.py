"""Sparse and dense retrieval over chunks for many questions in one plan, rank fusion, caps and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as fx

K1, B, RRF_K = 1.5, 0.75, 60
# Words that make a question one about all companies.
RETRIEVE_HINTS = ["哪家", "哪些", "谁", "排名", "最高", "最低", "对比", "所有", "11 家", "11家", "普遍", "各家"]
ANSWER_HINTS = ["哪家", "哪些", "谁", "排名", "最高", "最低", "对比", "所有", "普遍", "各家", "分别", "11 家", "11家", "全部"]


def postings(chunks: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)"""
    return chunks.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, dl)"""
    return chunks.select(key, F.size(tokens).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return stats.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def dictionary(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)"""
    n = corpus_stats(stats).select("n_docs")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(chunks: DataFrame, key: str, text: str, questions: DataFrame, tokens=fx.index_tokens) -> DataFrame:
    """(qid, key, score) of all chunks that share a term with questions(qid, question); a repeated question term counts once.

    Only rows of question terms leave the scan: the terms' table is as small as the
    questions, so the tokens meet it before anything is shuffled.
    """
    split = chunks.select(key, tokens(F.col(text)).alias("_t"))  # once a text, not once a token
    wanted = questions.select("qid", F.explode(fx.query_tokens(F.col("question"))).alias("term")).distinct()
    terms = wanted.select("term").distinct()
    hits = split.select(key, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term")).join(terms, "term", "left_semi")
    tf = hits.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    total = corpus_stats(doc_stats(split, key, F.col("_t")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    return weighted.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, *tie: Column, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k best rows for each question with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), *tie)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


#: Bytes of query vectors that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def vector_scores(vectors: DataFrame, key: str, column: str, queries: DataFrame) -> DataFrame:
    """(qid, key, score): dot products of queries(qid, query array) with unit vectors.

    Every query meets every vector. Queries that fit the bound are broadcast; more
    meet the vectors block by block, a partition of theirs with one of vectors.
    """
    q = queries.select("qid", F.transform("query", lambda x: x.cast("double")).alias("query"))
    size = q.agg(F.coalesce(F.sum(8 * F.size("query") + 64), F.lit(0))).first()[0]
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q
    dot = F.aggregate(F.zip_with(F.transform(column, lambda x: x.cast("double")), "query", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, column).crossJoin(q).select("qid", key, F.round(dot, 6).alias("score"))


def filtered_after(ranked: DataFrame, members: DataFrame, key: str, condition: Column, k: int) -> DataFrame:
    """Top k among rows of an already cut ranking: what lies below the cut can't come back."""
    rows = ranked.join(members, key).where(condition)
    w = Window.partitionBy("qid").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def fuse(lists: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(qid, key, score, first_seen) of lists(qid, list_no, rank, key): reciprocal ranks summed, a chunk in several lists counting in each."""
    return lists.groupBy("qid", key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.col("list_no") * 1_000_000 + F.col("rank")).alias("first_seen")
    )


def cap(ranked: DataFrame, group: Column, limit: int, order: list[Column], applies: Column | None = None) -> DataFrame:
    """At most ``limit`` rows of a group for each question, the best first; rows it doesn't apply to pass."""
    applies = F.lit(True) if applies is None else applies
    w = Window.partitionBy("qid", applies, group).orderBy(*order)
    return ranked.withColumn("_n", F.row_number().over(w)).where(~applies | (F.col("_n") <= limit)).drop("_n")


def named_in(c: Column, names: list[str]) -> Column:
    """Distinct names in a text, in the names' order."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(c, n))


def route(c: Column, names: list[str], hints: list[str] = ANSWER_HINTS) -> Column:
    """fanout for a question about all, multi for two names or more, else global."""
    count = F.size(named_in(c, names))
    hinted = F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(c, h))
    return F.when(hinted & (count < 2), "fanout").when(count >= 2, "multi").otherwise("global")


def answer_route(c: Column, names: list[str], hints: list[str] = ANSWER_HINTS, retrieve_hints: list[str] = RETRIEVE_HINTS) -> Column:
    """The mode of an answer: first by the answer's own hints, which may only make it a fanout, then as retrieval routes."""
    return F.when(route(c, names, hints) == "fanout", "fanout").otherwise(route(c, names, retrieve_hints))


def window_of(mode: Column) -> Column:
    """Blocks of context: 22 for a fan-out, else 8."""
    return F.when(mode == "fanout", 22).otherwise(8)


def pack_context(blocks: DataFrame, label: Column, text: Column, order: str = "rank") -> DataFrame:
    """(qid, context): numbered, labelled blocks; few by the window, so a question's are gathered."""
    w = Window.partitionBy("qid").orderBy(order)
    line = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), label, F.lit("\n"), text)
    numbered = blocks.withColumn("_i", F.row_number().over(w)).select("qid", "_i", line.alias("line"))
    return numbered.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "line"))), lambda x: x["line"]), "\n\n").alias("context"))
