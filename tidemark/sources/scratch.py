"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="tidemark-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a stored table, in files by the columns `by`: its lineage is cut, and it survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of this size in bytes is dealt out before costly work: it may lie in one row group, and so in one task. A larger one has tasks enough, a smaller one needs none.
DEALT_BYTES = (1 << 18, 1 << 28)


def dealt(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores; a large one as it is, as a shuffle would cost more than it gains."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if DEALT_BYTES[0] <= size <= DEALT_BYTES[1] else df


#: Bytes of an Arrow batch that Python workers get, unless the session sets another size than Spark's own: long texts take several times their bytes there, in each of an executor's workers.
BATCH_BYTES, SPARKS_BATCH_BYTES, BATCH_CONF = "8m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_CONF) in (SPARKS_BATCH_BYTES, "67108864", "64MB"):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
