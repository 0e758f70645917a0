"""Ranks, top-k and reciprocal-rank fusion. Every order is total, so every rank is row_number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows, ranked from 1: TakeOrderedAndProject, then a window over those k rows alone."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    """Ranks within groups, the first k of each. With k, WindowGroupLimit cuts groups before they are shuffled."""
    got = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return got.filter(F.col(rank) <= k) if k is not None else got


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group that is last by `order`; a map-side maximum, no sort of whole groups."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the least position of each."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def fuse(lists: DataFrame, key: str = "key", k: int = 60, limit: int | None = None, distinct: bool = True, lists_by: str = "list", position: str = "position") -> DataFrame:
    """Reciprocal-rank fusion of (list, key, position): score = sum of 1 / (k + rank), order (score desc, key).

    With `distinct`, a key that repeats in a list votes once, at its first place, and ranks are given after
    repeats are gone. Without it, places count as they are.
    """
    ranked = lists
    if distinct:
        once = lists.groupBy(lists_by, key).agg(F.min(position).alias(position))
        ranked = once.withColumn(position, F.row_number().over(Window.partitionBy(lists_by).orderBy(position, key)))
    # votes are added in the order of lists, so that sums of doubles don't depend on the plan
    votes = F.array_sort(F.collect_list(F.struct(F.col(lists_by).alias("l"), (1.0 / (k + F.col(position))).alias("v"))))
    score = F.aggregate(votes, F.lit(0.0), lambda s, x: s + x["v"])
    fused = ranked.groupBy(key).agg(score.alias("score"))
    order = [F.col("score").desc(), F.col(key).asc()]
    return top(fused, order, limit) if limit is not None else top_per(fused.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all")
