"""Shared helpers: table access, materialising, names that can't clash, and vectorised hashing."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

U64 = np.uint64

#: Bytes of an Arrow batch that Python workers get, unless the session sets another size than Spark's own.
BATCH_BYTES, SPARKS_BATCH_BYTES, BATCH_CONF = "8m", "67108864b", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters that vectorised steps work on at a time.
SLICE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers get smaller Arrow batches, so that a batch of long texts stays small."""
    if spark.conf.get(BATCH_CONF, SPARKS_BATCH_BYTES) == SPARKS_BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            path = tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._written = path
    return again


def release(*frames: DataFrame) -> None:
    """Remove the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def drawn(df: DataFrame, by: str, rows: int, keep: Column | None = None, over: int = 8) -> list:
    """keep (by default the column `by` itself) of the `rows` distinct values of `by` whose hashes are least, in that order: the same for one table however its files are cut. The driver gets no more rows than that."""
    hashed = df.where(F.col(by).isNotNull()).select(F.xxhash64(by).alias("h"), (F.col(by) if keep is None else keep).alias("value"))
    n = hashed.count()
    # Most tables have enough values under a bound that about `over` times as many rows pass; only else all values are sorted.
    parts = [hashed.where(F.col("h") < int(2**64 * (over * rows / n)) - 2**63)] if n > over * rows else []
    for part in [*parts, hashed]:
        found = part.dropDuplicates(["h"]).orderBy("h").limit(rows).collect()
        if len(found) == rows:
            break
    return [r.value for r in found]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but the needed ones under a name of no operator's, and the names of all its columns now."""
    now = {c: c if c in needed else f"__column{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*now.values()), now


def once_per_worker(key: tuple, make):
    """make(), kept for later tasks of the same Python worker, in the place of what was kept for other keys: functions that travel by value have no module of their own to keep it in."""
    held = sys.modules.setdefault("_tidemark_worker", type(sys)("_tidemark_worker")).__dict__
    if held.get("key") != key:
        held["value"] = None
        held.update(key=key, value=make())
    return held["value"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def runs(sizes, budget: int):
    """Ranges of neighbours whose sizes sum up to `budget` at most, at least one each."""
    at, n = 0, 0
    for k, size in enumerate(sizes):
        if k > at and n + size > budget:
            yield at, k
            at, n = k, 0
        n += size
    if len(sizes):
        yield at, len(sizes)


def slices(texts: list[str], budget: int = SLICE):
    """Ranges of texts of about `budget` characters in all, at least one text each."""
    return runs([len(t) for t in texts], budget)


def append_columns(df: DataFrame, fields: str, fn) -> DataFrame:
    """df with the columns `fields` (DDL) made by fn(record batch) -> list of arrays; columns of those names in df give way."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    df = df.drop(*[f.name for f in new])
    names = [*df.columns, *[f.name for f in new]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
