"""Physical hints that hold at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carex.session import materialise


def checked_broadcast(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Materialise `df` and broadcast it only if it has at most `max_rows` rows.

    Beyond that the frame comes back without a hint, and the planner (with AQE) picks a shuffled join.
    """
    kept = materialise(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def heaviest(df: DataFrame, keys: list[str], weight: str, k: int = 256) -> DataFrame:
    """The `k` keys with the greatest `weight`: at most `k` rows, whatever the input, so it may be broadcast.

    Every key that is left out has less than 1/k of the total weight.
    """
    return df.orderBy(F.desc(weight), *keys).limit(k)
