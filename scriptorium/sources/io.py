"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a missing path is an empty table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).dropna("all")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """An object of records as (key, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a header, quotes doubled inside quotes, fields over several lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_vectors(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    return spark.read.schema(f"{key} string, embedding array<float>").parquet(path)


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of NAME=value lines; blank lines, comments and lines without = are skipped."""
    # Spark's readers skip files whose names begin with a dot; settings lie beside the driver.
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    parts = [x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x]
    return spark.createDataFrame([(n.strip(), v.strip()) for n, v in parts], "name string, value string")


def load_env(spark: SparkSession, path: str) -> None:
    """Sets what isn't set yet; a settings file is a few lines."""
    for row in read_env(spark, path).toLocalIterator():
        os.environ.setdefault(row["name"], row["value"])


def resolve_setting(*names: str) -> str:
    """The first environment variable that is set; raises if none is."""
    for name in names:
        if os.environ.get(name):
            return os.environ[name]
    raise KeyError(" or ".join(names))


def retried(call: Callable[[], object], waits: tuple[float, ...] = (2, 5), jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; one try more than there are waits, then the last error."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception:
            if wait is None:
                raise
            sleep(wait + random.random() * jitter)


def http_json(url: str, form: dict | None = None, timeout: float = 30):
    """POST of a form if there is one, else GET, as JSON, with retries."""

    def call():
        data = urllib.parse.urlencode(form).encode() if form is not None else None
        with urllib.request.urlopen(urllib.request.Request(url, data=data), timeout=timeout) as reply:
            return json.load(reply)

    return retried(call)


def paged(fetch: Callable[[int], tuple[list, int]], size: int = 30, last_page: int = 5) -> Iterator:
    """Rows of a remote scan page by page; ends at the total, at an empty page or after the last page."""
    seen = 0
    for page in range(1, last_page + 1):
        rows, total = fetch(page)
        yield from rows
        seen += len(rows)
        if not rows or seen >= total:
            return


def is_downloaded(size: Column, expected: Column) -> Column:
    """Over 1 KB and within 5 % of the size that was announced."""
    return (size > 1024) & (F.abs(size - expected) <= 0.05 * expected)


def is_pdf(content: Column) -> Column:
    return F.startswith(content.cast("binary"), F.lit(b"%PDF"))


def resolve_first(wanted: DataFrame, hits: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(found, failed): for each wanted key the first hit of equal key, and those without one."""
    first = hits.groupBy(key).agg(F.min(F.struct(order, F.struct(*[c for c in hits.columns if c != key]).alias("hit"))).alias("b"))
    found = wanted.join(first.select(key, "b.hit.*"), key)
    return found, wanted.join(hits.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8, other scripts kept; append adds files, a commit each."""
    df.write.mode(mode).json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A report of one row as a JSON object."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def update_by_key(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """df with the updates' values where they have the key and aren't null."""
    names = [c for c in updates.columns if c != key and c in df.columns]
    joined = df.join(updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns])


def write_version(df: DataFrame, path: str, apply: bool = False) -> str | None:
    """A dry run unless ``apply``; then a new version beside the old ones, whose path is returned."""
    if not apply:
        return None
    target = f"{path}/v{int(time.time() * 1000)}"
    df.write.json(target)
    return target
