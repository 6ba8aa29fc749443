"""Round-based progress: spines, latest status as of a round, trajectories.

Rounds are few per key (at most a handful by protocol), so the spine is generated per key and no cross join is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_spine(df: DataFrame, keys: Sequence[str], round_col: str = "round", last: int | None = None) -> DataFrame:
    """Every key at every round from 1 to the last one (of the key, or the one given)."""
    top = df.groupBy(*keys).agg(F.max(round_col).alias("_last")).where("_last is not null")
    until = F.col("_last") if last is None else F.lit(last)
    return top.select(*keys, F.explode(F.sequence(F.lit(1), F.greatest(until, F.lit(1)))).alias(round_col))


def as_of(df: DataFrame, keys: Sequence[str], value: str, round_col: str = "round", last: int | None = None, default=None) -> DataFrame:
    """The latest known value up to each round."""
    spine = round_spine(df, keys, round_col, last)
    w = Window.partitionBy(*keys).orderBy(round_col).rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(df.select(*keys, round_col, value), [*keys, round_col], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def iteration_status(success: str = "success", local: str = "has_local_issues", blocked: str = "blocked_by_dependency"):
    """success > local_failed > dependency_blocked > not_run."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.when(flag(success), "success").when(flag(local), "local_failed").when(flag(blocked), "dependency_blocked").otherwise("not_run")


def first_success(df: DataFrame, keys: Sequence[str], round_col: str = "round", success: str = "success") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(F.when(F.col(success), F.col(round_col))).alias("first_success_round"),
        F.max(round_col).alias("last_round"),
        F.coalesce(F.max_by(success, round_col), F.lit(False)).alias("final_success"),
    )


def trajectory(df: DataFrame, keys: Sequence[str], group: Sequence[str], last: int, round_col: str = "round", success: str = "success") -> DataFrame:
    """Share of keys that have succeeded as of each round; a key not seen yet counts as not successful."""
    state = as_of(df, keys, success, round_col, last, False)
    return state.groupBy(*group, round_col).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col(success)).alias("n_success")).withColumn("rate", F.round(F.try_divide(F.col("n_success").cast("double"), F.col("n_keys")), 6))
