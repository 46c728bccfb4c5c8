"""Tables that cut lineage, in the folder that all executors share, and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch between the JVM and Python: what a Python worker holds follows it, not the number of rows.
BATCH = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one is set where it is unset, in local mode only (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-"))
    return spark.sparkContext.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/scriptorium/{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for this session, unless it has a smaller bound."""
    now = str(spark.conf.get(_LIMIT)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH:
        spark.conf.set(_LIMIT, BATCH)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the run's folder and return the table that reads it."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scriptorium_path", None)
        if path:
            _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables of this application. Frames that operators have returned read some of them: write those first."""
    _delete(spark, run_dir(spark))
