"""A corpus pipeline of five stages. Each reads what the stage before it kept and returns the columns of documents, the last one the encoded texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe_codec import bpe_codec
from scriptorium.llm.decontaminate import decontaminate
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.language_id import keep_known_language
from scriptorium.llm.minhash_dedup import minhash_dedup
from scriptorium.llm.workdir import materialize


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id the verdicts keep; rows without doc_id can't be judged by id and stay."""
    kept = verdicts.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    return known.unionByName(docs.where(F.col("doc_id").isNull()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, so without a language, go."""
    return keep_known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return _keep(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles the smallest doc_id stays."""
    return _keep(docs, minhash_dedup(docs, shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    return _keep(docs, found.select("doc_id", (~F.col("contaminated")).alias("kept")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with their digests."""
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"), store=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_codec", encode),
]

#: Language profiles, MinHash and the tokenizer aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir; each stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
