"""Price table from provider price-list JSON (S10) and price lookup with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIM = "struct<unit:string,pricePerUnit:map<string,string>,description:string>"
_TERM = f"struct<priceDimensions:map<string,{_DIM}>>"
PRICE_ITEM_SCHEMA = (
    f"struct<product:struct<sku:string,attributes:map<string,string>>,terms:struct<OnDemand:map<string,{_TERM}>>>"
)


def prices_from_price_list(raw: DataFrame, expected_unit: Column | str, *, json_col: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """One USD unit price per price-list item: the first OnDemand term / price
    dimension (in document order) whose unit matches; invalid JSON or no match -> no row.

    Terms and dimensions are exploded with their positions (maps keep JSON
    order), filtered, and the first match per item is kept by a min over
    (term position, dimension position) - all within the item's row group.
    """
    unit = F.lit(expected_unit) if isinstance(expected_unit, str) else expected_unit
    parsed = raw.select(*keep, F.col(json_col), F.from_json(F.col(json_col), PRICE_ITEM_SCHEMA).alias("p"), unit.alias("_unit"))
    terms = parsed.select(
        *keep,
        F.col(json_col),
        "_unit",
        F.col("p.product.sku").alias("sku"),
        F.col("p.product.attributes").alias("attributes"),
        F.posexplode(F.col("p.terms.OnDemand")).alias("tpos", "term_code", "term"),
    )
    dims = terms.select(
        *keep,
        F.col(json_col),
        "_unit",
        "sku",
        "attributes",
        "tpos",
        F.posexplode(F.col("term.priceDimensions")).alias("dpos", "rate_code", "dim"),
    )
    hits = dims.where(F.col("dim.unit") == F.col("_unit")).withColumn("usd", F.col("dim.pricePerUnit")["USD"].try_cast("double")).where(
        F.col("usd").isNotNull()
    )
    first = hits.groupBy(*keep, json_col).agg(
        F.min(F.struct("tpos", "dpos", "usd", "sku", "_unit")).alias("m"),
        F.first("attributes").alias("attributes"),  # one value per item (same parsed document)
    )
    return first.select(
        *keep,
        F.col("m.sku").alias("sku"),
        "attributes",
        F.col("m._unit").alias("unit"),
        F.col("m.usd").alias("unit_price_usd"),
        F.lit("pricing_api").alias("source"),
    )


def price_lookup(
    df: DataFrame,
    prices: DataFrame,
    *,
    region: Column,
    kind: str,
    key: Column,
    fallback: dict[str, float] | None = None,
    default_price: float | None = None,
) -> DataFrame:
    """Attach ``unit_price`` and ``price_confidence``.

    ``prices(region, kind, key, unit_price, source)`` is a dimension (few rows
    per region x kind x key); matching is an equi-join on (region, kind, key).
    When no price exists the fixed fallback table for the key, then the default,
    is used, with lower confidence.
    """
    p = prices.where(F.col("kind") == kind).select(
        F.col("region").alias("_pr"), F.col("key").alias("_pk"), F.col("unit_price").alias("_price"), F.col("source").alias("_psrc")
    )
    j = df.withColumn("_r", region).withColumn("_k", key).join(p, (F.col("_r") == F.col("_pr")) & (F.col("_k") == F.col("_pk")), "left")
    fb = F.lit(None).cast("double")
    if fallback:
        fb = F.element_at(F.create_map(*[x for k, v in fallback.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("_k"))
    price = F.coalesce(F.col("_price"), fb, F.lit(default_price).cast("double"))
    conf = F.when(F.col("_price").isNotNull(), F.when(F.col("_psrc") == "pricing_api", 90).otherwise(80)).when(fb.isNotNull(), 60).when(
        F.lit(default_price).isNotNull(), 40
    ).otherwise(0)
    return j.withColumn("unit_price", price).withColumn("price_confidence", conf).drop("_r", "_k", "_pr", "_pk", "_price", "_psrc")


@dataclass(frozen=True)
class Rung:
    """One place to look a price up: the wanted region and key, or fixed ones, and how far a hit is trusted."""

    confidence: int
    region: str | None = None
    key: str | None = None


#: the wanted key here, any key here, the wanted key anywhere, any key anywhere
LADDER = (Rung(90), Rung(75, key="default"), Rung(60, region="global"), Rung(50, region="global", key="default"))
#: confidence of a price no table gave
ASSUMED = 30


def price_ladder(
    df: DataFrame, prices: DataFrame | None, *, kind: str, region: Column, key: Column, as_of=None, rungs: Sequence[Rung] = LADDER, fallback: dict[str, float] | float | None = None, name: str = "unit_price"
) -> DataFrame:
    """``df`` with ``name`` and ``<name>_confidence`` from the first rung that has a price.

    ``prices``: region, kind, key, unit_price, and optionally effective_from; of several rows the
    newest in force at ``as_of`` counts, and prices that are not positive do not. Only the
    distinct (region, key) pairs of ``df`` climb the ladder: they are exploded by rung, meet the
    table in one join, and keep the hit of least rung; that small result joins back. Without
    any hit ``fallback`` (a price, or one by key) stands in with little confidence.
    """
    if isinstance(fallback, dict):
        entries = [x for k, v in fallback.items() for x in (F.lit(k), F.lit(float(v)))]
        assumed = F.try_element_at(F.create_map(*entries), F.col("_wk"))
    else:
        assumed = F.lit(fallback).cast("double")
    asked = df.withColumns({"_wr": region, "_wk": key})
    if prices is not None:
        dated = "effective_from" in prices.columns
        since = F.col("effective_from").cast("timestamp") if dated else F.lit(None).cast("timestamp")
        p = prices.where((F.col("kind") == kind) & (F.col("unit_price") > 0)).select(F.col("region").alias("_pr"), F.col("key").alias("_pk"), F.col("unit_price").cast("double").alias("_price"), since.alias("_since"))
        if as_of is not None:
            p = p.where(F.col("_since").isNull() | (F.col("_since") <= F.lit(as_of).cast("timestamp")))
        epoch = F.lit("0001-01-01").cast("timestamp")
        p = p.groupBy("_pr", "_pk").agg(F.max_by("_price", F.struct(F.coalesce("_since", epoch), "_price")).alias("_price"))
        places = F.array(*[F.struct((F.lit(r.region) if r.region else F.col("_wr")).alias("_pr"), (F.lit(r.key) if r.key else F.col("_wk")).alias("_pk"), F.lit(r.confidence).alias("_conf")) for r in rungs])
        tries = asked.select("_wr", "_wk").distinct().select("_wr", "_wk", F.posexplode(places).alias("_rung", "_at")).select("_wr", "_wk", "_rung", "_at.*")
        best = tries.join(p, ["_pr", "_pk"]).groupBy("_wr", "_wk").agg(F.min_by(F.struct("_price", "_conf"), "_rung").alias("_hit"))
        asked = asked.join(best, ["_wr", "_wk"], "left")
        found, trust = F.col("_hit._price"), F.col("_hit._conf")
    else:
        found, trust = F.lit(None).cast("double"), F.lit(None).cast("int")
    confidence = F.when(found.isNotNull(), trust).when(assumed.isNotNull(), ASSUMED).otherwise(0)
    return asked.withColumns({name: F.coalesce(found, assumed), f"{name}_confidence": confidence}).select(*df.columns, name, f"{name}_confidence")
