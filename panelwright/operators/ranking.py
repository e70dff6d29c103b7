"""Sorting and top-k (SRT*, WIN9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.scalars import lookup
from panelwright.functions.windows import rank_in_group


def ranked(df: DataFrame, by: str, tie: Sequence[str]) -> DataFrame:
    """Descending order with explicit tie-breaks (SRT2): a range-partitioned sort."""
    return df.orderBy(F.col(f"`{by}`").desc_nulls_last(), *[F.col(f"`{t}`") for t in tie])


def top_per_group(
    df: DataFrame, group: str, by: str, n: int, tie: Sequence[str], rank: str = "Rank"
) -> DataFrame:
    """The n best rows per group with their rank (SRT3).

    The literal limit turns into a WindowGroupLimit: each task sends at most n rows per group.
    """
    order = [F.col(f"`{by}`").desc_nulls_last(), *[F.col(f"`{t}`") for t in tie]]
    return df.withColumn(rank, rank_in_group(group, order)).filter(F.col(rank) <= n)


def top_by_limit(
    df: DataFrame, group: str, by: str, limits: Mapping, tie: Sequence[str], rank: str = "Rank"
) -> DataFrame:
    """The best rows per group with a limit per group; groups without a limit drop out (SRT4).

    The largest limit is applied first as a literal, so limiting still happens before the shuffle.
    """
    known = df.filter(F.col(group).isin(list(limits)))
    best = top_per_group(known, group, by, max(limits.values()), tie, rank)
    return best.filter(F.col(rank) <= lookup(group, dict(limits)))
