"""op2: all documents into 16 shards of near-equal bytes."""

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .shards import histogram_shards


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    placed = histogram_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
