"""Joins whose keys may be null: a null subject is a group of its own and meets only itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "inner", where=None) -> DataFrame:
    """Equi join on keys, null equal to null; the keys come out once, from the left."""
    own = right.select(*[F.col(c).alias(f"{c}__k") if c in keys else F.col(c) for c in right.columns])
    met = F.lit(True) if where is None else where
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    return left.join(own, met, how).drop(*[f"{k}__k" for k in keys])
