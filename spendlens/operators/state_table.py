"""State kept as a table of hash buckets, updated in place of full rewrites.

Rows of a key always lie in bucket ``hash(key) % buckets``. An update reads and rewrites
the buckets its keys fall into, as a new version beside the old files, and then publishes
a manifest - one file naming the version of every bucket. Readers take the newest
manifest, so they see an update as a whole or not at all, and a failed or repeated update
leaves the published state alone. What the driver holds is one row a bucket.

    <root>/data/version=<n>/bucket=<b>/*.parquet
    <root>/manifests/version=<n>/*.parquet        (bucket, data_version)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, int]]:
    """(newest version, bucket -> version its rows lie in); (0, {}) without a table."""
    try:
        all_of = spark.read.schema("bucket int, data_version int, version int").parquet(f"{root}/manifests")
    except AnalysisException:
        return 0, {}
    newest = all_of.agg(F.max("version").alias("v")).first()["v"]
    if newest is None:
        return 0, {}
    return newest, {r["bucket"]: r["data_version"] for r in all_of.where(F.col("version") == newest).collect()}


def _places(root: str, versions: dict[int, int]) -> list[str]:
    """Folders of the buckets that have rows (version 0: none yet)."""
    return [f"{root}/data/version={v}/bucket={b}" for b, v in sorted(versions.items()) if v]


def read_state(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The published rows (without the bucket column)."""
    _, versions = manifest(spark, root)
    if not versions:
        if schema is None:
            raise ValueError(f"no state table at {root}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*_places(root, versions))


def upsert_state(rows: DataFrame, root: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS) -> list[int]:
    """Merge ``rows`` into the table at ``root`` and return the buckets rewritten.

    ``merge`` maps old and new rows together to the rows kept (one a key, as ``latest_per_key``);
    it must give the same result when an update is repeated. ``buckets`` is fixed by the first
    update. ``rows`` are read twice: pass stored or cheap ones.
    """
    spark = rows.sparkSession
    version, versions = manifest(spark, root)
    if versions:
        buckets = len(versions)
    touched = sorted(r["b"] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    old = _places(root, {b: v for b, v in versions.items() if b in set(touched)})
    both = spark.read.parquet(*old).unionByName(rows, allowMissingColumns=True) if old else rows
    new = version + 1
    merged = merge(both).withColumn("bucket", bucket_of(keys, buckets))
    # a repeated attempt at this version replaces what a failed one left
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/data/version={new}")
    now = {b: new if b in set(touched) else versions.get(b, 0) for b in range(buckets)}
    spark.createDataFrame(sorted(now.items()), "bucket int, data_version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/version={new}")
    return touched
