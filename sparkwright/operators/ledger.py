"""Run ledgers: last-wins consolidation, best runs, missing cells, resume sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column | None = None) -> DataFrame:
    """The last row by ``order`` of each key, among the valid ones. An aggregate, not a window: hot keys combine before the shuffle.

    Null keys form a group of their own. ``order`` must be total; of rows that are equal in it any one is kept.
    """
    rows = df if valid is None else df.where(valid)
    pick = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_r")).select("_r.*")


def best_by(df: DataFrame, keys: Sequence[str], choice: str, *score: Column) -> DataFrame:
    """The choice with the greatest score tuple; the choice itself is the last tie-break."""
    return df.groupBy(*keys).agg(F.max_by(F.col(choice), F.struct(*score, F.col(choice))).alias(f"best_{choice}"))


def missing_cells(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def replace_slice(base: DataFrame, update: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` whose key ``update`` has give way to those of ``update``."""
    return base.join(update.select(*keys).distinct(), list(keys), "left_anti").unionByName(update)


def occurrence_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate."""
    pick = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_r")).select("_r.*")
