"""Recorded calls of two programs compared: canonical values, a full outer compare, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import batch, canonical_json

NUMERIC = ("int", "long", "short", "byte", "float", "double", "int32_t", "int64_t", "size_t")
_canon = batch(canonical_json)


def compare(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """One row per method of either side (method, arguments array<struct<type, value_json>>): ok, arity, type, value, or which side is missing.

    Number types may stand for each other. NaN and infinities are an error of the canonical form. Null arguments are no arguments.
    """
    none = F.array().cast("array<struct<type:string,value_json:string>>")
    side = lambda d, n: d.select("method", F.coalesce("arguments", none).alias(n))
    j = side(src, "a").join(side(tgt, "b"), "method", "full_outer")
    pairs = j.select("method", "a", "b", F.posexplode_outer(F.arrays_zip(F.coalesce("a", none).alias("x"), F.coalesce("b", none).alias("y"))).alias("pos", "p"))
    kind = lambda c: F.when(c.isin(*NUMERIC), F.lit("number")).otherwise(c)
    x, y = F.col("p.x"), F.col("p.y")
    # an argument that only one side has is a matter of arity, not of type
    fault = F.when(x.isNull() | y.isNull(), 0).when(kind(x["type"]) != kind(y["type"]), 2).when(_canon(x["value_json"]) != _canon(y["value_json"]), 1).otherwise(0)
    g = pairs.withColumn("fault", fault).groupBy("method").agg(F.max("fault").alias("fault"), F.first(F.size("a")).alias("na"), F.first(F.size("b")).alias("nb"), F.bool_or(F.col("a").isNull()).alias("no_a"), F.bool_or(F.col("b").isNull()).alias("no_b"))
    out = F.when(F.col("no_a"), "missing_source").when(F.col("no_b"), "missing_target").when(F.col("na") != F.col("nb"), "arity").when(F.col("fault") == 2, "type").when(F.col("fault") == 1, "value").otherwise("ok")
    return g.select("method", out.alias("outcome"))


def coverage(result: DataFrame) -> DataFrame:
    checked = ~F.col("outcome").startswith("missing")
    return result.agg(F.count_if(checked).alias("covered"), F.count(F.lit(1)).alias("methods"), F.try_divide(F.count_if(checked).cast("double"), F.count(F.lit(1))).alias("coverage"))


SCHEMA = T.StructType([T.StructField("method", T.StringType()), T.StructField("arguments", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value_json", T.StringType())])))])
