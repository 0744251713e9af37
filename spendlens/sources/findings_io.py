"""Findings / cost-facts storage: scans (S1-S5), writers (S6-S8), JSON export (S9), preflight.

Layout: ``<root>/tenant_id=<t>/run_date=<yyyy-mm-dd>/part-*.parquet`` (zstd),
so tenant and run filters prune directories before any file is opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import freed_shuffles

ROWS_PER_FILE = 200_000


def read_findings(spark: SparkSession, path: str | Sequence[str], *, schema=None) -> DataFrame:
    """Scan one or several findings datasets, union by name (schema drift tolerant)."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("mergeSchema", "true")
    out = union_findings([reader.parquet(p) for p in paths])
    if schema is not None:
        missing = [fld for fld in schema.fields if fld.name not in out.columns]
        for fld in missing:
            out = out.withColumn(fld.name, F.lit(None).cast(fld.dataType))
    return out


def union_findings(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a dataset exists and has at least one row (driver-side, reads one row)."""
    try:
        return len(spark.read.parquet(path).limit(1).collect()) > 0
    except AnalysisException:
        return False


def choose_dataset(spark: SparkSession, enriched: str, raw: str, correlated: str | None = None) -> DataFrame:
    """S3: the enriched dataset when it has rows, else raw ∪ correlated."""
    if has_rows(spark, enriched):
        return read_findings(spark, enriched)
    paths = [raw] + ([correlated] if correlated and has_rows(spark, correlated) else [])
    return read_findings(spark, paths)


def scan_run(spark: SparkSession, path: str, tenant_id: str, workspace_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Partition-pruned scan (tenant directory) with the other keys pushed into Parquet."""
    df = spark.read.parquet(path).where(F.col("tenant_id") == tenant_id)
    if workspace_id and "workspace_id" in df.columns:
        df = df.where(F.col("workspace_id") == workspace_id)
    if run_id and "run_id" in df.columns:
        df = df.where(F.col("run_id") == run_id)
    return df


def with_run_date(findings: DataFrame) -> DataFrame:
    """run_date partition value: date of run_ts, else today (UTC session)."""
    return findings.withColumn("run_date", F.coalesce(F.to_date("run_ts"), F.current_date()).cast("string"))


def read_written(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """What ``write_findings`` wrote from ``columns``, in its columns and types: directory names are
    text whatever they look like, and a blank tenant (Spark's default directory) is blank again."""
    df = spark.read.schema(with_run_date(columns).schema).parquet(path)
    return df.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(""))).select(columns.columns)


def write_findings(findings: DataFrame, root: str, *, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE, gather: bool = True) -> None:
    """Partitioned, zstd, bounded files; dynamic partition overwrite replaces
    only the (tenant, run_date) partitions present in ``findings`` (U3/U4 semantics).

    The rebalance hint gathers each partition's rows in few writer tasks (few files per
    directory), and lets AQE split one that exceeds the advisory partition size among several
    tasks: a tenant that holds a third of all rows is no single task. ``maxRecordsPerFile``
    bounds the files. ``gather=False`` is for findings that lie so already (dealt before
    they got wide, or read from such a dataset) and need not move again.
    """
    df = with_run_date(findings)
    with freed_shuffles(findings.sparkSession):
        (
            (df.hint("rebalance", "tenant_id", "run_date") if gather else df)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .option("maxRecordsPerFile", rows_per_file)
            .partitionBy("tenant_id", "run_date")
            .parquet(root)
        )


def write_cost_facts(
    facts: DataFrame,
    root: str,
    *,
    by_period: bool = True,
    by_account: bool = True,
    by_service: bool = False,
    by_region: bool = False,
    mode: str = "overwrite",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Cost facts partitioned by tenant + the chosen columns; hot partitions and files are
    bounded as in ``write_findings``."""
    cols = ["tenant_id"] + [c for c, on in (("billing_period", by_period), ("account_id", by_account), ("service", by_service), ("region", by_region)) if on]
    (
        facts.hint("rebalance", *cols)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*cols)
        .parquet(root)
    )


def _json_ready(df: DataFrame) -> DataFrame:
    """Decimals as strings, dates/timestamps ISO (the export wire format)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "decimal":
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif t == "timestamp":
            out.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f.name))
        elif t == "date":
            out.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def export_json(artifacts: dict[str, DataFrame], out_dir: str, *, rows_per_file: int = ROWS_PER_FILE) -> dict[str, str]:
    """Write each artifact (findings, summary, top_savings, coverage, correlated) as JSON lines.

    Files are gzipped (plain lines of all findings are many times the tables they come from);
    a reader takes such a file whole, so ``rows_per_file`` bounds them."""
    paths = {}
    for name, df in artifacts.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        _json_ready(df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(p, compression="gzip")
        paths[name] = p
    return paths
