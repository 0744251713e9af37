"""The most frequent keys of a count table, as many as fit a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_from(counts: DataFrame, n: str, bound: int) -> int:
    """The least power of two such that at most ``bound`` rows have a count of that or more.

    Counts are grouped by their number of binary digits: at most 63 rows.
    """
    sizes = {r["digits"]: r["rows"] for r in counts.groupBy(F.length(F.bin(n)).alias("digits")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    total, least = 0, 63
    for digits in sorted(sizes, reverse=True):
        total += sizes[digits]
        if total > bound:
            break
        least = digits
    return 1 << (least - 1)
