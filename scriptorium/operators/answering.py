"""A written index, and retrieval and answering of many questions composed in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scriptorium.functions import text as fx

from . import retrieval as rt
from . import verify as vf

LISTED, POOL, FINAL, FAN, NAMED = 20, 400, 8, 2, 6


def write_index(chunks: DataFrame, key: str, text: str, folder: str, tokens=fx.index_tokens, mode: str = "overwrite") -> None:
    """Postings (term, key, tf, dl) and lengths (key, dl) as Parquet; append adds an increment of new chunks.

    Postings are ordered by term within ranges, so a reader that asks for some terms
    skips the files and row groups of others by their statistics.
    """
    split = chunks.select(key, tokens(F.col(text)).alias("_t"))
    split.select(key, F.size("_t").cast("long").alias("dl")).write.mode(mode).parquet(f"{folder}/lengths")
    posts = split.select(key, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    posts.repartitionByRange("term", key).sortWithinPartitions("term").write.mode(mode).parquet(f"{folder}/postings")


def bm25_indexed(spark: SparkSession, folder: str, key: str, questions: DataFrame, tokens=fx.query_tokens) -> DataFrame:
    """(qid, key, score) as retrieval.bm25 gives them, from the tables of write_index."""
    wanted = questions.select("qid", F.explode(tokens(F.col("question"))).alias("term")).distinct()
    hits = spark.read.parquet(f"{folder}/postings").join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    total = rt.corpus_stats(spark.read.parquet(f"{folder}/lengths"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (rt.K1 + 1) / (F.col("tf") + rt.K1 * (1 - rt.B + rt.B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    scored = hits.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(total))
    return scored.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def retrieve(sparse: DataFrame, dense: DataFrame, chunks: DataFrame, key: str, group: str, questions: DataFrame, names: list[str], table: Column | None = None) -> DataFrame:
    """qid, mode, rank, key, group, score, bm25_rank, vec_rank: the blocks of every question, each by its own mode.

    sparse and dense are scored rows (qid, key, score); questions(qid, question). A
    question is a fanout over all names, multi over those it names, or global; a name's
    sparse list comes out of the best 400. ``table`` (null outside tables) groups parts
    of one table, of which two stay; a fanout keeps two blocks of a group. Ranks of an
    arm are null where its list doesn't hold the block.
    """
    q = questions.select("qid", rt.answer_route(F.col("question"), names).alias("mode"), rt.named_in(F.col("question"), names).alias("named"))
    every = F.array(*[F.lit(n) for n in names])
    wanted = F.when(F.col("mode") == "fanout", every).when(F.col("mode") == "multi", F.col("named"))
    wanted = q.select("qid", F.when(F.col("mode") == "fanout", FAN).otherwise(NAMED).alias("per"), F.explode(wanted).alias(group))
    groups = chunks.select(key, group, (F.lit(None).cast("string") if table is None else table).alias("_table"))
    arms, lists = [], None
    for number, scored, tie in ((0, sparse, F.col(key).desc()), (1, dense, F.col(key))):
        pool = scored if number else rt.top_k(scored, POOL, tie).drop("rank")
        own = rt.top_k(pool.join(groups.drop("_table"), key).join(F.broadcast(wanted), ["qid", group]), NAMED, tie, by=("qid", group)).where("rank <= per")
        best = rt.top_k(scored, LISTED, tie).select("qid", F.lit(number).alias("list_no"), "rank", key)
        arms.append(best)
        own = own.select("qid", (number + 2 * F.array_position(every, F.col(group))).cast("int").alias("list_no"), "rank", key)
        lists = best.unionByName(own) if lists is None else lists.unionByName(best).unionByName(own)
    fused = rt.fuse(lists, key).join(groups, key).join(q.select("qid", "mode"), "qid")
    order = [F.col("score").desc(), F.col("first_seen"), F.col(key)]
    capped = rt.cap(fused, F.col("_table"), 2, order, applies=F.col("_table").isNotNull())
    capped = rt.cap(capped, F.col(group), FAN, order, applies=F.col("mode") == "fanout")
    top = rt.top_k(capped, 22, *order[1:]).where(F.col("rank") <= rt.window_of(F.col("mode")))
    rank_of = lambda arm, name: arm.select("qid", key, F.col("rank").alias(name))
    met = top.join(rank_of(arms[0], "bm25_rank"), ["qid", key], "left").join(rank_of(arms[1], "vec_rank"), ["qid", key], "left")
    return met.select("qid", "mode", "rank", key, group, "score", "bm25_rank", "vec_rank")


def check_answers(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """answers(qid, answer) against blocks(qid, rank, text): n_blocks, valid, invalid, checked, unsupported, ok. A window is 22 blocks at most."""
    held = blocks.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    met = answers.join(held, "qid", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    met = met.withColumn("c", vf.citations(F.col("answer"), F.size("texts"))).withColumn("unsupported", vf.unsupported_numbers(F.col("answer"), F.col("texts")))
    return met.select("qid", "answer", F.size("texts").cast("long").alias("n_blocks"), "c.valid", "c.invalid", F.size(fx.checked_numbers(F.col("answer"))).cast("long").alias("checked"), "unsupported", (F.size("unsupported") == 0).alias("ok"))


def answer(blocks: DataFrame, questions: DataFrame, label: Column, text: str, ask: Callable[[str, str], str]) -> DataFrame:
    """check_answers of what ``ask(question, context)`` says for each question; a question without a block gets an empty context. Errors of ask are raised."""
    context = rt.pack_context(blocks, label, F.col(text))
    asked = questions.select("qid", "question").join(context, "qid", "left").select("qid", "question", F.coalesce("context", F.lit("")).alias("context"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "answer": [ask(q, c) for q, c in zip(b["question"], b["context"])]})

    said = asked.mapInPandas(run, questions.select("qid").schema.add("answer", "string"))
    return check_answers(said, blocks.select("qid", "rank", F.col(text).alias("text")))


def segmented(rows: DataFrame, key: str, text: str, cut: Callable[[str], list[str]], stop: list[str] = fx.STOP_WORDS) -> DataFrame:
    """(key, tokens) by an injected word segmenter; blank, stop and one-letter words go. Where there is none, fx.bigram_tokens serves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop = set(stop)
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": [[w for w in cut(t or "") if w.strip() and w not in drop and len(w) > 1] for t in b[text]]})

    return rows.select(key, text).mapInPandas(run, rows.select(key).schema.add("tokens", ArrayType(StringType())))


def completeness(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors and whether every chunk can have one."""
    n = chunks.agg(F.count("*").alias("chunks"))
    return n.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("vectors")))).withColumn("complete", F.col("vectors") >= F.col("chunks"))


def evidence_matrix(locators: DataFrame, chunks: DataFrame, key: str, retrieved: DataFrame, questions: list[int]) -> DataFrame:
    """The locators' chunks, each with a flag for every question: whether its retrieved(qid, key) rows hold the chunk."""
    flags = retrieved.groupBy(key).agg(*[F.max(F.col("qid") == q).alias(f"in_{q}") for q in questions])
    met = locators.join(chunks, key, "left").join(flags, key, "left")
    return met.select(*[c for c in met.columns if not c.startswith("in_")], *[F.coalesce(f"in_{q}", F.lit(False)).alias(f"in_{q}") for q in questions])


def evidence_violations(locators: DataFrame, chunks: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """(key, problem) of locators(key, value, owner): no_chunk, no_value or other_group; none for a sound table."""
    met = locators.join(chunks.select(key, F.col(text).alias("_text"), F.col(group).alias("_group"), F.lit(True).alias("_there")), key, "left")
    problem = F.when(F.col("_there").isNull(), "no_chunk").when(~F.coalesce(F.contains("_text", F.col("value")), F.lit(False)), "no_value").when(~F.col("_group").eqNullSafe(F.col("owner")), "other_group")
    return met.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def with_facts(questions: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Questions with facts(key, facts); an empty array where there are none."""
    met = questions.join(facts, key, "left")
    return met.withColumn("facts", F.coalesce("facts", F.array().cast(facts.schema["facts"].dataType)))


def with_contexts(questions: DataFrame, contexts: DataFrame, on: str, size: int = 2500) -> DataFrame:
    """Questions that have a context by their text, once each, with the context's first characters as the template takes them."""
    first = contexts.groupBy(on).agg(F.min("context").alias("context"))
    return questions.join(first, on).withColumn("context", F.substring("context", 1, size))


def capped_cells(rows: DataFrame, cell: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each cell, as an evaluation run takes them."""
    w = Window.partitionBy(cell).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def keep_rate(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: raw, kept and kept over raw."""
    n = raw.agg(F.count("*").alias("raw")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))
    return n.withColumn("keep_rate", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("raw")), 3))


def with_files(manifest: DataFrame, files: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing): manifest rows whose page file exists, and the others, which a build skips with a warning."""
    return manifest.join(files, key), manifest.join(files.select(key), key, "left_anti")


def verbatim(evidence: Column, chunk: Column) -> Column:
    """是 if the evidence isn't blank and stands in the chunk, else 否."""
    e = fx.strip(F.coalesce(evidence, F.lit("")))
    return F.when((e != "") & F.coalesce(F.contains(chunk, e), F.lit(False)), "是").otherwise("否")
