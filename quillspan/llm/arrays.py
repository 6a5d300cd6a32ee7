"""Array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(items: Column, n: int) -> Column:
    """Each n neighbours as a struct (t0, t1 and so on), in order; none if there are fewer items.

    Slices lie side by side, and no lambda names the array: where the planner writes items out in place (as in the filters that it
    infers from an explode) they are made a few times, not once a run.
    """
    size = F.greatest(F.size(items) - (n - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(items, k + 1, size).alias(f"t{k}") for k in range(n)))
