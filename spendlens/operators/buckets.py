"""Bucket storage cost from storage gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..sources.prices import price_lookup
from .detect import _draft

BUCKET = ["tenant_id", "account_id", "region", "bucket_name"]

# Storage types of the size gauge in report order, the class each is priced as,
# and the price (USD a GB and month) where the price table has none.
STORAGE_TYPES = [
    ("StandardStorage", "Standard", 0.023),
    ("StandardIAStorage", "Standard - Infrequent Access", 0.0125),
    ("OneZoneIAStorage", "One Zone - Infrequent Access", 0.0100),
    ("IntelligentTieringFAStorage", "Intelligent-Tiering Frequent Access", 0.023),
    ("IntelligentTieringIAStorage", "Intelligent-Tiering Infrequent Access", 0.0125),
    ("IntelligentTieringAAStorage", "Intelligent-Tiering Archive Access", 0.0040),
    ("GlacierStorage", "Glacier Flexible Retrieval", 0.0040),
    ("GlacierIRStorage", "Glacier Instant Retrieval", 0.0050),
    ("DeepArchiveStorage", "Glacier Deep Archive", 0.00099),
]
#: confidence of a looked-up and of a fallback price
PRICED, ASSUMED = 80, 55


def latest_class_sizes(gauges: DataFrame, as_of, lookback_days: int = 3) -> DataFrame:
    """The newest point of each bucket and storage type in the look-back, in GiB.

    ``gauges``: the bucket's four keys, ts, and one column of bytes a storage type (NULL: no
    point; types without a column have none). Wide points are unpivoted to one row a type and
    reduced by ``max_by`` - one partial aggregate, no sort. A newest point that is not positive
    leaves the type out.
    """
    now = F.lit(as_of).cast("timestamp")
    there = [t for t, _, _ in STORAGE_TYPES if t in gauges.columns]
    recent = gauges.where((F.col("ts") >= now - F.make_interval(days=F.lit(max(1, lookback_days)))) & (F.col("ts") < now))
    recent = recent.select(*BUCKET, "ts", *[F.col(t).cast("double").alias(t) for t in there])
    long = recent.unpivot([*BUCKET, "ts"], there, "storage_type", "bytes").where(F.col("bytes").isNotNull())
    newest = long.groupBy(*BUCKET, "storage_type").agg(F.max_by("bytes", F.struct("ts", "bytes")).alias("bytes"))
    return newest.where(F.col("bytes") > 0).select(*BUCKET, "storage_type", (F.col("bytes") / 1024.0**3).cast("decimal(24,6)").alias("size_gib"))


def bucket_storage_breakdown(sizes: DataFrame, prices: DataFrame) -> DataFrame:
    """Per bucket the total size and cost, the least price confidence and the items as JSON.

    ``prices``: region, kind ``s3_gb_month``, key (storage class), unit_price, source. A bucket
    has at most nine items; they keep the report order and have their keys sorted.
    """
    classes = F.create_map(*[F.lit(x) for t, c, _ in STORAGE_TYPES for x in (t, c)])
    places = F.create_map(*[x for i, (t, _, _) in enumerate(STORAGE_TYPES) for x in (F.lit(t), F.lit(i))])
    s = sizes.withColumns({"storage_class": classes[F.col("storage_type")], "place": places[F.col("storage_type")]})
    usable = prices.where(F.col("unit_price") > 0)
    s = price_lookup(s, usable, region=F.col("region"), kind="s3_gb_month", key=F.col("storage_class"), fallback={c: p for _, c, p in STORAGE_TYPES})
    priced = F.col("price_confidence") >= 80
    s = s.withColumn("usd", F.col("unit_price").cast("decimal(12,6)"))
    s = s.withColumns({"cost": (F.col("size_gib") * F.col("usd")).cast("decimal(24,6)"), "source": F.when(priced, "price_table").otherwise("fallback"), "conf": F.when(priced, PRICED).otherwise(ASSUMED)})
    six = lambda c: F.col(c).cast("string")
    item = F.struct(
        F.col("place"),
        F.struct(
            six("cost").alias("monthly_cost_usd"), F.col("source").alias("price_source"), F.col("storage_class").alias("pricing_storage_class"),
            six("size_gib").alias("size_gib"), F.col("storage_type"), six("usd").alias("usd_per_gb_month"),
        ).alias("item"),
    )
    g = s.groupBy(*BUCKET).agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("size_gib").alias("total_gib"), F.sum("cost").alias("total_usd"), F.min("conf").alias("confidence"))
    return g.select(*BUCKET, "total_gib", "total_usd", "confidence", F.to_json(F.transform("items", lambda x: x["item"])).alias("breakdown_json"))


def bucket_storage_estimate(gauges: DataFrame, prices: DataFrame, as_of, *, lookback_days: int = 3, min_gib: float = 10.0) -> DataFrame:
    """Buckets of at least ``min_gib``, with their estimated monthly storage cost."""
    b = bucket_storage_breakdown(latest_class_sizes(gauges, as_of, lookback_days), prices).where(F.col("total_gib") >= min_gib)
    return _draft(
        b, service=F.lit("AmazonS3"), resource_type=F.lit("bucket"), resource_id=F.col("bucket_name"), check_id=F.lit("aws.s3.cost.bucket.storage.estimate"),
        status=F.lit("info"), severity_level=F.lit("low"), severity_score=F.lit(20), monthly_cost=F.round("total_usd", 2).cast(MONEY), confidence=F.col("confidence").cast("int"),
        detail=F.concat_ws("|", F.col("total_gib").cast("decimal(24,4)").cast("string"), F.col("total_usd").cast("decimal(24,4)").cast("string"), "breakdown_json"),
    )
