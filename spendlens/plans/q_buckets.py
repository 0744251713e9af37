"""Registered bucket storage estimate."""

from __future__ import annotations

from ..operators.buckets import STORAGE_TYPES, bucket_storage_estimate
from ..sources.bind import bound, binding_cte
from .q_detect import _sel
from .registry import query

AS_OF = "2024-02-01 00:00:00"
# several classes and regions have no row, one row has no usable price
PRICES = [
    ("us-east-1", "Standard", 0.023), ("us-east-1", "Glacier Flexible Retrieval", 0.0036), ("us-east-1", "Glacier Deep Archive", 0.0),
    ("eu-west-1", "Standard", 0.024), ("eu-west-1", "Standard - Infrequent Access", 0.0131), ("ap-southeast-2", "Glacier Instant Retrieval", 0.0055),
]
_TYPES = "(VALUES " + ", ".join(f"({i}, '{t}', '{c}', CAST({p} AS DOUBLE))" for i, (t, c, p) in enumerate(STORAGE_TYPES)) + ") AS t(place, storage_type, storage_class, fallback)"
_PRICES = "(VALUES " + ", ".join(f"('{r}', '{c}', CAST({p} AS DOUBLE))" for r, c, p in PRICES) + ") AS p(region, storage_class, price)"
_KEYS = "tenant_id, account_id, region, bucket_name"


@query(
    "d38_bucket_storage",
    oracle=binding_cte("bucket_gauges")
    + f""",
recent AS (SELECT * FROM bucket_gauges WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND ts < TIMESTAMP '{AS_OF}'),
points AS ({" UNION ALL ".join(f"SELECT {_KEYS}, ts, '{t}' AS storage_type, CAST({t} AS DOUBLE) AS bytes FROM recent WHERE {t} IS NOT NULL" for t, _, _ in STORAGE_TYPES)}),
newest AS (SELECT {_KEYS}, storage_type, CAST(bytes / 1073741824.0::DOUBLE AS DECIMAL(24,6)) AS gib FROM points QUALIFY row_number() OVER (PARTITION BY {_KEYS}, storage_type ORDER BY ts DESC, bytes DESC) = 1),
priced AS (SELECT n.*, place, storage_class, CAST(COALESCE(price, fallback) AS DECIMAL(12,6)) AS usd, price IS NOT NULL AS found, CAST(gib * CAST(COALESCE(price, fallback) AS DECIMAL(12,6)) AS DECIMAL(24,6)) AS cost
           FROM newest n JOIN {_TYPES} USING (storage_type) LEFT JOIN (SELECT * FROM {_PRICES} WHERE price > 0) q USING (region, storage_class) WHERE gib > 0),
b AS (SELECT {_KEYS}, sum(gib) AS total_gib, sum(cost) AS total_usd,
             min(CASE WHEN found THEN 80 ELSE 55 END) AS conf,
             '[' || string_agg('{{"monthly_cost_usd":"' || CAST(cost AS VARCHAR) || '","price_source":"' || CASE WHEN found THEN 'price_table' ELSE 'fallback' END || '","pricing_storage_class":"' || storage_class
                 || '","size_gib":"' || CAST(gib AS VARCHAR) || '","storage_type":"' || storage_type || '","usd_per_gb_month":"' || CAST(usd AS VARCHAR) || '"}}', ',' ORDER BY place) || ']' AS breakdown
      FROM priced GROUP BY ALL)
SELECT """
    + _sel(service="AmazonS3", rtype="bucket", rid="bucket_name", check="aws.s3.cost.bucket.storage.estimate", status="'info'", lvl="'low'", score="20", cost="CAST(round(total_usd, 2) AS DECIMAL(18,6))", conf="conf",
           detail="CAST(CAST(round(total_gib, 4) AS DECIMAL(18,4)) AS VARCHAR) || '|' || CAST(CAST(round(total_usd, 4) AS DECIMAL(18,4)) AS VARCHAR) || '|' || breakdown")
    + " FROM b WHERE total_gib >= 10",
)
def d38(spark, sf):
    prices = spark.createDataFrame([(r, "s3_gb_month", c, p, "pricing_api") for r, c, p in PRICES], "region string, kind string, key string, unit_price double, source string")
    return bucket_storage_estimate(bound(spark, sf, "bucket_gauges"), prices, AS_OF)
