"""What the engine needs of a session."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_made: set[str] = set()


#: Rows of an Arrow batch, where a session has Spark's default of 10,000: rows here are whole texts.
BATCH_ROWS = 1000


#: Environment of Python workers, where it says nothing else: what they free goes back to the system, as a worker waits
#: beside the executor's heap for its next task, which may be long in coming.
WORKERS = {"MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def with_package(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver has it (elsewhere, ship it by spark.submit.pyFiles), give freed
    memory back, and get texts in batches of a few megabytes, unless the session says how many rows they get."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in WORKERS.items():
        if name not in env:
            env[name] = value
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session without one, on a local master, gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"/tmp/checkpoints/{os.getuid()}"


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below shared_dir(), which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/recordloom/{spark.sparkContext.applicationId}"
    if path not in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(path)
    return path


def cleaned(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; results that were built on them can't be read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.discard(own_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def in_groups(df: DataFrame, keys: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """fold of the rows of each combination of keys, in any order, as rows of schema. Groups follow one another in Arrow
    batches of many: most have a few rows, and a batch for each would cost more than its fold."""
    out = arrow_schema(schema)

    def run(batches):
        group, at, done = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if group:
                        done += fold(group)
                    group, at = [], key
                group.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if group:
            yield pa.RecordBatch.from_pylist(fold(group), schema=out)

    with_package(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
