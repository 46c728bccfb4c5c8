"""Models as injected callables: one request a row, batches over Arrow, failures as values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .io import retried


def generate_rows(chunks: DataFrame, ask: Callable[[str], list[dict]], text: str, fields: list[str], keep: list[str]) -> DataFrame:
    """One row in, several out: the records of ``ask`` for each text; a failed call gives none. Concurrency is the partitions."""
    schema = chunks.select(*keep).schema
    for f in fields:
        schema = schema.add(f, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    answers = retried(lambda r=record: ask(r[text]))
                except Exception:
                    answers = []
                rows += [[record[k] for k in keep] + [a.get(f) for f in fields] for a in answers]
            yield pd.DataFrame(rows, columns=[*keep, *fields])

    return chunks.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def judge(rows: DataFrame, cache: DataFrame, key: str, text: str, ask: Callable[[str], tuple[int, int, str]]) -> DataFrame:
    """(key, grounded, natural, reason): cached verdicts of zero or more stay, the others are asked; a failed call is -1, -1."""
    good = cache.where("grounded >= 0").select(key, "grounded", "natural", "reason")
    schema = rows.select(key).schema.add("grounded", "integer").add("natural", "integer").add("reason", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text]):
                try:
                    out.append((k, *retried(lambda t=t: ask(t))))
                except Exception as e:
                    out.append((k, -1, -1, str(e)[:80]))
            yield pd.DataFrame(out, columns=[key, "grounded", "natural", "reason"])

    asked = rows.join(good.select(key), key, "left_anti").select(key, text).mapInPandas(run, schema)
    return good.join(rows.select(key), key, "left_semi").unionByName(asked)


def keep_rule(grounded: Column, natural: Column) -> Column:
    return (grounded >= 2) & (natural == 1)


def embed(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 8, limit: int | None = None, instruction: str = "") -> DataFrame:
    """(key, embedding) of unit length; a batch that fails is halved, a row that fails alone raises. Whole texts unless ``limit`` names a number of characters; questions take their model's ``instruction`` before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def halves(texts):
            try:
                return list(encode(texts))
            except Exception:
                if len(texts) == 1:
                    raise
                m = len(texts) // 2
                return halves(texts[:m]) + halves(texts[m:])

        for part in batches:
            out = []
            for lo in range(0, len(part), batch):
                out += halves([instruction + t[:limit] for t in part[text].iloc[lo : lo + batch]])
            yield pd.DataFrame({key: part[key], "embedding": out})

    made = rows.select(key, text).mapInPandas(run, rows.select(key).schema.add("embedding", ArrayType(DoubleType())))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return made.select(key, F.transform("embedding", lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float")).alias("embedding"))
