"""Nested records and bounded contexts of headers and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["project", "run_id"]


def output_name(key: Column) -> Column:
    """The file that a header is written to."""
    return F.concat(F.translate(key, "$", "_"), F.lit(".h"))


def last_failures(feedback: DataFrame) -> DataFrame:
    """The last report of each header (by round, then id), where it is none of success."""
    cols = [c for c in feedback.columns if c not in (*RUN, "header_key")]
    by = F.struct(F.col("round").isNotNull(), "round", "feedback_id")
    last = feedback.groupBy(*RUN, "header_key").agg(F.max_by(F.struct(*cols), by).alias("r")).select(*RUN, "header_key", "r.*")
    return last.where(~F.coalesce("success", F.lit(False)))


def failure_summaries(feedback: DataFrame, width: int = 240) -> DataFrame:
    """Per failed header its flags and the list of its issues' details, each on one line of at most ``width`` characters."""
    blocks = F.filter(F.coalesce("diagnostic_blocks", F.array().cast("array<string>")), lambda b: b != "")
    details = F.transform(blocks, lambda b: F.substring(F.regexp_replace(b, r"\s+", " "), 1, width))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return last_failures(feedback).select(*RUN, "header_key", "round", flag("has_local_issues"), flag("blocked_by_dependency"), details.alias("details"))


def eval_records(headers: DataFrame, methods: DataFrame) -> DataFrame:
    """One record per header with its distinct includes and its functions (signature, code), both sorted. A record is as long as its header."""
    keys = [*RUN, "header_key"]
    h = headers.where("header_key is not null")
    inc = h.select(*keys, F.explode("include_dependencies").alias("inc")).where("inc is not null").groupBy(*keys).agg(F.sort_array(F.collect_set("inc")).alias("includes"))
    f = methods.where("method_key is not null").groupBy(*keys, "method_key").agg(F.min("code").alias("code"))
    f = f.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("method_key").alias("signature"), F.col("code").alias("function_code")))).alias("functions"))
    x = h.groupBy(*keys).agg(F.min("ai").alias("ai")).join(inc, keys, "left").join(f, keys, "left")
    empty = F.array().cast("array<struct<signature:string,function_code:string>>")
    return x.select(*keys, "ai", output_name(F.col("header_key")).alias("file_name"), F.coalesce("includes", F.array().cast("array<string>")).alias("includes"), F.coalesce("functions", empty).alias("functions"))


def _nearest(candidates: DataFrame, keys: list[str], rank: Column, k: int, keep: list[Column]) -> DataFrame:
    best = candidates.groupBy(*keys, "other").agg(F.min(rank).alias("rank"))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "other"))
    return best.withColumn("rn", rn).where(F.col("rn") <= k).select(*keys, "other", *keep, "rn")


def _written(headers: DataFrame) -> DataFrame:
    """(project, run_id, other, file) of headers that have a translation."""
    return headers.where("header_key is not null").where(F.trim(F.coalesce("raw_translated_code", F.lit(""))) != "").select(*RUN, F.col("header_key").alias("other"), output_name(F.col("header_key")).alias("file")).distinct()


def _included(headers: DataFrame) -> DataFrame:
    inc = headers.select(*RUN, "header_key", F.explode("include_dependencies").alias("file")).where("file is not null").distinct()
    return inc.join(_written(headers), [*RUN, "file"]).select(*RUN, "header_key", "other").distinct()


_ERROR_FILE = r"(?:^|\n)\s*(?:[^\s:/]*/)*([^\s:/]+\.(?:h|hpp)):\d+:\d+: (?:fatal )?error:"


def repair_context(feedback: DataFrame, headers: DataFrame, k: int = 4) -> DataFrame:
    """Up to ``k`` other translated headers for each that failed last: where its blocks' errors lie, in their order, then what it includes."""
    last = last_failures(feedback)
    named = last.select(*RUN, "header_key", F.posexplode("diagnostic_blocks").alias("at", "block")).select(*RUN, "header_key", F.regexp_extract("block", _ERROR_FILE, 1).alias("file"), (F.col("at") + 1).alias("at"))
    first = named.join(_written(headers), [*RUN, "file"]).select(*RUN, "header_key", "other", F.lit(0).alias("tier"), "at")
    then = last.select(*RUN, "header_key").join(_included(headers), [*RUN, "header_key"]).select(*RUN, "header_key", "other", F.lit(1).alias("tier"), F.lit(0).alias("at"))
    return _nearest(first.union(then).where("other <> header_key"), [*RUN, "header_key"], F.struct("tier", "at"), k, [])


def method_context(headers: DataFrame, methods: DataFrame, calls: DataFrame, k: int = 4) -> DataFrame:
    """Up to ``k`` translated headers for each method: own includes, callees' headers, callees' includes."""
    m = methods.where("method_key is not null and header_key is not null").groupBy(*RUN, "method_key").agg(F.min("header_key").alias("header_key"))
    inc = _included(headers)
    callee = calls.join(m.select(*RUN, F.col("method_key").alias("dst"), F.col("header_key").alias("ch")), [*RUN, "dst"]).join(m.select(*RUN, F.col("method_key").alias("src")), [*RUN, "src"], "left_semi").select(*RUN, F.col("src").alias("method_key"), "ch").distinct()
    cols = [*RUN, "method_key", "other"]
    own = m.join(inc, [*RUN, "header_key"]).select(*cols, F.lit(0).alias("tier"))
    heads = callee.join(_written(headers).select(*RUN, F.col("other").alias("ch"), "other"), [*RUN, "ch"]).select(*cols, F.lit(1).alias("tier"))
    far = callee.join(inc.withColumnRenamed("header_key", "ch"), [*RUN, "ch"]).select(*cols, F.lit(2).alias("tier"))
    cand = own.union(heads).union(far).join(m, [*RUN, "method_key"]).where("other <> header_key")
    return _nearest(cand, [*RUN, "method_key"], F.col("tier"), k, [F.col("rank").alias("tier")])


def old_turn(content: Column, width: int = 300) -> Column:
    """A turn shortened: one that holds tool results keeps its end, any other its beginning and a remark."""
    holds = F.expr("true") & F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(content), "$.tool_results", "variant")).startswith("ARRAY"), F.lit(False))
    return F.when(holds, F.right(content, F.lit(width))).otherwise(F.concat(F.substring(content, 1, width), F.lit("\n...[truncated early interaction]")))
