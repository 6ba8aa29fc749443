"""Rates, averages, shares and pivots of experiment results. All are partial aggregates; nothing is gathered.

Empty groups: a rate's value is a parameter (0.0, 1.0 or null). A null success counts as the parameter says.
Null measures are left out of averages; a share of nothing is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_flag(c: Column, missing: bool) -> Column:
    """A success column with the meaning of null made explicit."""
    return F.coalesce(c.cast("boolean"), F.lit(missing))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(float(empty)))


def rate(success: Column, where: Column | None = None, empty: float | None = None) -> Column:
    """Share of successes among the rows where ``where`` holds, as an aggregate."""
    keep = F.lit(True) if where is None else where
    return ratio(F.count_if(keep & success), F.count_if(keep), empty)


def micro(num: Column, den: Column) -> Column:
    """Sum over sum, over the rows that have both."""
    both = num.isNotNull() & den.isNotNull()
    return ratio(F.sum(F.when(both, num)), F.sum(F.when(both, den)))


def macro(metric: Column) -> Column:
    """Mean over the rows that have the metric; flags count as 0 and 1."""
    return F.avg(metric.cast("double"))


def weighted(flag: Column, weight: Column) -> Column:
    return ratio(F.sum(F.when(flag, weight).otherwise(0)), F.sum(weight))


def percent(num: Column, den: Column) -> Column:
    return F.round(ratio(num, den, 0.0) * 100, 2)


def fixed_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: Column, name: str) -> DataFrame:
    """Conditional aggregates over a fixed list of values: one pass, a stable schema, absent ones null."""
    out = [F.sum(F.when(F.col(column) == v, value)).alias(f"{name}_{str(v).lower().replace(' ', '_').replace('-', '_')}") for v in values]
    return df.groupBy(*keys).agg(*out)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def with_values(df: DataFrame, dimension: DataFrame, bound: int = 1000) -> DataFrame:
    """Each row with every value of a one-column dimension, a list of names of checked size: an explode, not a join."""
    values = [r[0] for r in dimension.where(F.col(dimension.columns[0]).isNotNull()).distinct().limit(bound + 1).collect()]
    if len(values) > bound:
        raise ValueError(f"{dimension.columns[0]} has more than {bound} values: no list to lay a grid over")
    kind = dimension.schema[0].dataType
    return df.withColumn(dimension.columns[0], F.explode(F.array(*map(F.lit, sorted(values))).cast(f"array<{kind.simpleString()}>")))


def on_grid(df: DataFrame, grid: Sequence[DataFrame], keys: Sequence[str], fill: dict) -> DataFrame:
    """Every combination of the grid's dimensions, absent ones filled; all but the first are lists of names."""
    spine = grid[0]
    for g in grid[1:]:
        spine = with_values(spine, g)
    return spine.join(df, list(keys), "left").na.fill(fill)


def best_with_ties(df: DataFrame, keys: Sequence[str], choice: str, score: str, joiner: str = ";") -> DataFrame:
    """The best score of each group, the smallest choice that has it, and all ties in order."""
    top = df.groupBy(*keys).agg(F.max(score).alias("best_score"))
    hit = df.join(top, list(keys)).where(F.col(score) == F.col("best_score"))
    return hit.groupBy(*keys).agg(F.first("best_score").alias("best_score"), F.min(choice).alias("best_choice"), F.array_join(F.sort_array(F.collect_set(F.col(choice).cast("string"))), joiner).alias("ties"))


def list_order(lists: dict[str, list[str]]) -> list[Column]:
    """Sort keys that follow given lists of values, one a column; values that a list does not name come last."""
    return [F.when((at := F.array_position(F.array(*map(F.lit, vs)), F.col(c))) > 0, at).otherwise(len(vs) + 1) for c, vs in lists.items()]
