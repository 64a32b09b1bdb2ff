"""The one order of rankings: score from high to low, equal scores by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], score: str, tie: list[str], k: int | None = None, ascending: bool = False, digits: int | None = 9) -> DataFrame:
    """df with `rank` from 1 within group, cut at k. Scores that agree in `digits` decimals are ties, so that sums made in
    another order rank alike. Spark prunes to k before and after the shuffle."""
    s: Column = F.round(F.col(score), digits) if digits is not None else F.col(score)
    w = Window.partitionBy(*group).orderBy(s.asc() if ascending else s.desc(), *tie)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)
