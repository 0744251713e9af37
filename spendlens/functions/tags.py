"""Tag predicates (P13 suppression, P14 non-production, D7 required keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_tags(tags: Column) -> Column:
    """lower/trim keys and values, NULL value -> '', blank keys dropped."""
    m = F.transform_values(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(F.coalesce(v, F.lit("")))))
    m = F.transform_keys(m, lambda k, v: F.lower(F.trim(k)))
    return F.map_filter(m, lambda k, v: k != "")


def suppressed(
    tags: Column,
    keys: Sequence[str],
    values: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    *,
    value_only_if_key_suppressed: bool = False,
    prefix_only_if_key_suppressed: bool = True,
) -> Column:
    """A suppression key present, or a suppression value, or a value prefix."""
    n = normalize_tags(tags)
    ks = F.array(*[F.lit(k.strip().lower()) for k in keys]) if keys else F.array().cast("array<string>")
    vs = F.array(*[F.lit(v.strip().lower()) for v in values]) if values else F.array().cast("array<string>")
    entries = F.map_entries(n)
    key_hit = F.arrays_overlap(F.map_keys(n), ks)
    val_hit = F.exists(
        entries,
        lambda e: F.array_contains(vs, e["value"]) & (F.array_contains(ks, e["key"]) if value_only_if_key_suppressed else F.lit(True)),
    )
    out = F.coalesce(key_hit, F.lit(False)) | val_hit
    if prefixes:
        pre = [p.strip().lower() for p in prefixes if p.strip()]
        pref_hit = F.exists(
            entries,
            lambda e: (e["value"] != "")
            & (F.array_contains(ks, e["key"]) if prefix_only_if_key_suppressed else F.lit(True))
            & F.exists(F.array(*[F.lit(p) for p in pre]), lambda p: e["value"].startswith(p)),
        )
        out = out | pref_hit
    return F.coalesce(out, F.lit(False))


def non_production(tags: Column, env_keys: Sequence[str], nonprod_values: Sequence[str], mode: str = "equals", name_key: str | None = None) -> Column:
    """An environment tag whose value is (``equals``) or contains (``contains``) a non-prod word."""
    n = normalize_tags(tags)
    keys = [k.lower() for k in env_keys] + ([name_key.lower()] if name_key else [])
    vals = [v.lower() for v in nonprod_values]
    cond = F.exists(
        F.map_entries(n),
        lambda e: F.array_contains(F.array(*[F.lit(k) for k in keys]), e["key"])
        & (
            F.array_contains(F.array(*[F.lit(v) for v in vals]), e["value"])
            if mode == "equals"
            else F.exists(F.array(*[F.lit(v) for v in vals]), lambda w: F.instr(e["value"], w) > 0)
        ),
    )
    return F.coalesce(cond, F.lit(False))


def missing_required(tags: Column, required: Sequence[str], lower_keys: bool = True) -> Column:
    """Required keys whose value is missing or blank (array, in required order)."""
    m = normalize_tags(tags) if lower_keys else tags
    req = [k.lower() if lower_keys else k for k in required]
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(m[k]), F.lit("")) == "", F.lit(k)) for k in req]))
