"""Scan of billing exports whose files drifted apart.

Exports of several years hold files that lack columns, spell them differently or
changed their types. Files are grouped by their schema - one read per group, not per
file - and every group is normalized by its own columns (P8, P9) before the union, so a
spelling is resolved in the files that use it and types meet as the canonical ones.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.cost import normalize_cur


def export_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders that hold Parquet files under ``path``, sorted.

    The listing is a DataFrame (no file is opened); what reaches the driver is one name a
    folder - a billing period or an account in an export's layout - not one a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return sorted(r["folder"] for r in files.select(folder.alias("folder")).distinct().collect())


def _files(spark: SparkSession, folder: str) -> list[str]:
    return sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").toPandas()["path"])


def _merged_schema(spark: SparkSession, folder: str) -> StructType | None:
    """The schema of a folder whose files agree or only lack columns; None if types clash."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(folder).schema
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
        return None


def export_variants(spark: SparkSession, path: str) -> list[tuple[StructType, list[str]]]:
    """(schema, folders or files that have it) of an export, one entry a distinct schema.

    Column order does not make a schema. A folder in which types clash is looked at file by file.
    """
    found: dict[str, tuple[StructType, list[str]]] = {}
    for folder in export_folders(spark, path):
        merged = _merged_schema(spark, folder)
        parts = [(merged, folder)] if merged is not None else [(spark.read.parquet(f).schema, f) for f in _files(spark, folder)]
        for schema, place in parts:
            key = "|".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields))
            found.setdefault(key, (schema, []))[1].append(place)
    return [found[k] for k in sorted(found)]


def read_variant(spark: SparkSession, schema: StructType, places: list[str]) -> DataFrame:
    """The rows of one schema variant with the file each came from (``source_file``)."""
    rows = spark.read.schema(schema).parquet(*places)
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def scan_billing_export(spark: SparkSession, path: str, tenant_id: str, workspace_id: str = "", cost_model: str = "unblended") -> DataFrame:
    """S5 + P9: canonical cost facts of a drifting export, with ``source_file`` as lineage.

    The plan holds one scan per distinct schema; projections and filters on canonical columns
    reach each of them.
    """
    parts = []
    for schema, places in export_variants(spark, path):
        rows = read_variant(spark, schema, places)
        parts.append(normalize_cur(rows, tenant_id, workspace_id, cost_model, keep=("source_file",)))
    if not parts:
        raise ValueError(f"no Parquet files under {path}")
    return reduce(DataFrame.unionByName, parts)
