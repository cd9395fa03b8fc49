"""One function for all experiments: parameters by a frozen pool."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sweep(pool: DataFrame, grid: list[dict], cell: Callable[..., DataFrame]) -> DataFrame:
    """The union of ``cell(pool, **parameters)`` over the grid, parameters as columns.  Equal parts of the plan are shared."""
    parts = [cell(pool, **g).select("*", *(F.lit(v).alias(k) for k, v in g.items())) for g in grid]
    return reduce(DataFrame.unionByName, parts)
