"""Resumable stages as streams: the checkpoint is the list of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def run_increment(
    spark: SparkSession, source: str, schema: StructType | str, key: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> StreamingQuery:
    """Processes the files of ``source`` that no run has seen, each key once, and appends the stage's rows to ``sink``.

    A micro-batch is written under its number, so a batch that is run again after a
    failure replaces itself. Keys that are done lie in a table beside the checkpoint,
    which a batch is anti-joined with: no state in memory grows with them.
    """
    done = f"{checkpoint}/keys"

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        if number:
            seen = spark.read.schema(batch.select(key).schema.add("batch", "long")).parquet(done).where(F.col("batch") < number)
            fresh = fresh.join(seen, key, "left_anti")
        fresh = fresh.persist()
        stage(fresh).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{done}/batch={number}")
        fresh.unpersist()

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
