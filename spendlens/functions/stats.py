"""Order statistics over bounded series.

A series here is a per-resource list of daily points inside a lookback
window, so its length is bounded by the window (e.g. 14 or 30 points) no
matter how large the table is; collecting it per resource is safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_floor(values: Column, p: float) -> Column:
    """A17 (aggregate): sorted[int((n-1)*p)] of the collected values."""
    arr = F.array_sort(F.collect_list(values))
    idx = (F.floor((F.size(arr) - 1) * F.lit(p)) + 1).cast("int")
    return F.when(F.size(arr) > 0, F.element_at(arr, idx))


def percentile_nearest(values: Column, p: float) -> Column:
    """A18 (aggregate): sorted[round((n-1)*p)] (half to even, like Python round)."""
    arr = F.array_sort(F.collect_list(values))
    idx = (F.bround((F.size(arr) - 1) * F.lit(p), 0) + 1).cast("int")
    return F.when(F.size(arr) > 0, F.element_at(arr, idx))


def percentile_linear(values: Column, p: float) -> Column:
    """A16 (aggregate): linear interpolation between closest ranks (exact ``percentile``)."""
    return F.percentile(values, F.lit(p))
