"""Bounded samples that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 31


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows (all, where there are no more), chosen by a hash of ``key``: a filter, so nothing is gathered or sorted.

    The same rows are chosen on every run over the same table. ``n`` bounds the expected number; the chance of
    more than n + 6 sqrt(n) rows is below one in a million.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(_SPACE)) < F.lit(int(_SPACE * (n / total))))
