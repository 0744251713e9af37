"""Spark session helpers.

Only tests and local tools build a session here; library functions take the
caller's session (or derive it from a DataFrame) and never create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on (UTC wall clock, AQE re-planning,
# skew-join splitting). They are applied on top of whatever the cluster sets.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Findings are wide: what a join task reads in so many bytes it sorts for the next
    # exchange at some ten times the size, and that should fit its memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Wide record projections generate methods the JIT refuses to compile
    # (> 8000 bytecodes); above this size Spark splits the stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    """A local session for tests, tools and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPENDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-ckpt-"))
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what the context was given.

    Without either the call fails; there is no machine-local stand-in.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name no other job uses, in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in this block go when the write ends, not whenever the driver
    next collects garbage. Only for eager writes: nothing else reads their shuffles."""
    was = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used where one derived frame feeds several branches of a plan: the branches
    then scan the stored columns (with pushdown and nested pruning) instead of
    recomputing the lineage, and a lost executor re-reads files instead of
    replaying joins. The folder is the cluster's ``spark.checkpoint.dir``. What the step
    shuffled is freed once it is stored.
    """
    path = new_folder(df.sparkSession, f"materialized/{name}")
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_union(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """The union by name of ``frames``, stored frame by frame and read back as one scan: each is
    planned and run by itself, and what comes after is planned once, not once a frame."""
    spark = next(iter(frames.values())).sparkSession
    schema = reduce(DataFrame.unionByName, [spark.createDataFrame([], df.schema) for df in frames.values()]).schema
    root = new_folder(spark, f"materialized/{name}")
    for part, df in frames.items():
        with freed_shuffles(spark):
            df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(f"{root}/{part}")
    return spark.read.schema(schema).parquet(*[f"{root}/{part}" for part in frames])
