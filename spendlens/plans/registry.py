"""Query registry: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    headline: bool = False


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, headline)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from . import q_buckets, q_contract, q_correlate, q_cost, q_detect, q_emit, q_filesystems, q_history, q_read, q_remediation, q_rightsize, q_trends, q_vaults  # noqa: F401

    return REGISTRY
