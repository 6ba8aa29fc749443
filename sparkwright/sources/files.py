"""Readers and writers of the recorded outputs: sources, class records, call edges, traces, stubs, reports.

Readers give every column an explicit schema; nothing is inferred. Corrupt records become null rows that the
reader drops or marks, as each docstring says.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import batch, strip_comments
from ..operators.ledger import first_of, last_wins

METHOD = "struct<methodName:string,methodSignature:string,methodComment:string,methodBody:string,statementCount:int>"
CLASS_SPLIT = f"filePath string, className string, type string, imports array<string>, classDeclaration string, parentClass string, interfaces array<string>, fieldDeclarations array<string>, methods array<{METHOD}>, methodCount int"
TRACE = "run_id string, seq long, stage string, model string, prompt_tokens long, completion_tokens long, total_tokens long, cached_tokens long, elapsed_seconds double, prompt string, response string"
STUB = "class_name string, java_class string, header_code string, cpp_code string, methods array<struct<java_signature:string,cpp_declaration:string,body_location:string>>"
EDGE_COLUMNS = ("call_id", "enabled", "caller", "callee", "line", "caller_return", "callee_array_dim", "callee_obj_type", "raw_return", "actual_return", "caller_jar", "callee_jar", "description")


def java_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every *.java below a folder; bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(root)
    return raw.select("path", _decode(F.col("content")).alias("content"))


@F.pandas_udf(T.StringType())
def _decode(c: pd.Series) -> pd.Series:
    return c.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def parse_sources(files: DataFrame) -> DataFrame:
    """(path, package, type_name, qualified_name, imports) of (path, content); comments do not count."""
    code = batch(strip_comments)(F.col("content"))
    pkg = F.regexp_extract("code", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    name = F.regexp_extract("code", r"\b(?:class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)", 1)
    x = files.withColumn("code", code).select("path", pkg.alias("package"), F.when(name != "", name).otherwise(F.regexp_extract("path", r"([^/\\]+)\.java$", 1)).alias("type_name"), F.regexp_extract_all("code", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"), F.lit(1)).alias("imports"))
    return x.withColumn("qualified_name", F.when(F.col("package") == "", F.col("type_name")).otherwise(F.concat_ws(".", "package", "type_name")))


@F.pandas_udf(T.StringType())
def _decode_either(c: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("gbk", "replace")

    return c.map(one)


def class_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Class rows and method rows of one JSON file per class; files that are no UTF-8 are read as GBK, broken ones dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    rows = raw.select(F.from_json(_decode_either(F.col("content")), CLASS_SPLIT).alias("r")).select("r.*").where("className is not null")
    at = F.posexplode_outer("methods").alias("ord", "m")
    return rows.drop("methods"), rows.select("className", "filePath", at).where("m is not null").select("className", "filePath", "ord", "m.*")


def call_edges(spark: SparkSession, path: str, only_enabled: bool = False) -> DataFrame:
    """Call edges of a tab-separated file; lines of fewer than five columns are skipped, missing ones are null."""
    parts = F.split("value", "\t")
    x = spark.read.text(path).where(F.size(parts) >= 5).select(*[F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(EDGE_COLUMNS)])
    ints = ("call_id", "enabled", "line", "callee_array_dim", "caller_jar", "callee_jar")
    x = x.withColumns({c: F.expr(f"try_cast({c} as int)") for c in ints}).withColumns({"call_type": F.regexp_extract("callee", r"^\(([A-Z]*)\)", 1), "callee": F.regexp_replace("callee", r"^\([A-Z]*\)", "")})
    return x.where("enabled = 1") if only_enabled else x


def traces(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of model calls; lines that do not parse are dropped."""
    x = spark.read.schema(TRACE + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return x.where("_corrupt_record is null").drop("_corrupt_record")


def keyed_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A store of JSON lines in which the last line of a key wins. A file is read in blocks; a line's order is its block's start, then its place in the block."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_text"))
    rows = lines.where("trim(_text) <> ''").select("_file", "_block", "_line", F.from_json("_text", schema).alias("r")).where("r is not null").select("_file", "_block", "_line", "r.*").where(F.col(key).isNotNull())
    return last_wins(rows, [key], ["_file", "_block", "_line"]).drop("_file", "_block", "_line")


def state(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A checkpoint state; another version is an error when it is read."""
    x = spark.read.schema("version int, stage string, done boolean, detail string").json(path)
    return x.withColumn("version", F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unknown state version "), F.coalesce(F.col("version").cast("string"), F.lit("null")))).cast("int")))


def stubs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Stub definitions of ordered folders: the first folder that has a class wins; incomplete ones are skipped."""
    read = [spark.read.schema(STUB).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(f).withColumn("dir_priority", F.lit(i)) for i, f in enumerate(folders)]
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("class_name", "java_class", "header_code")]) & (F.size(F.coalesce("methods", F.array().cast("array<struct<java_signature:string,cpp_declaration:string,body_location:string>>"))) > 0)
    return first_of(reduce(DataFrame.unionByName, read).where(ok), ["class_name"], ["dir_priority", "java_class"])


def runs(spark: SparkSession, root: str, projects: list[str] | None = None, clean: DataFrame | None = None) -> DataFrame:
    """Runs found by their files' paths ``<version>/<project>/<ai>/runs/<run_id>/...``, but for those (project, run_id) that are clean already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")  # the content column is pruned
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/runs/([^/]+)/", i)
    x = files.select(part(1).alias("version"), part(2).alias("project"), part(3).alias("ai"), part(4).alias("run_id"), "modificationTime", "length").where("run_id <> ''")
    x = x.groupBy("version", "project", "ai", "run_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("modified"))
    x = x.where(F.col("project").isin(projects)) if projects else x
    return x.join(clean.select("project", "run_id"), ["project", "run_id"], "left_anti") if clean is not None else x


def run_log_status(log: Column, suffix: str) -> Column:
    """Per file of a suffix whether it compiled, from the last attempt of a run log that came to repair, before the repair: array of (file, ok)."""
    attempts = F.filter(F.split(log, r"(?m)^==================== .+ ====================[ \t]*$"), lambda a: a.contains("========== Agent repair"))
    before = F.element_at(F.split(F.coalesce(F.try_element_at(attempts, F.lit(-1)), F.lit("")), "========== Agent repair"), 1)
    lines = F.filter(F.transform(F.split(before, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(?:Compiled (?:header )?.+\.(?:h|cpp) successfully|Failed to compile (?:header )?.+\.(?:h|cpp))\.$"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(?:Compiled|Failed to compile) (?:header )?(.+\.(?:h|cpp))(?: successfully)?\.$", 1).alias("file"), x.startswith("Compiled").alias("ok")))
    return F.filter(pairs, lambda p: p["file"].endswith(suffix))


def top_level_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the *.java files directly in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.java").load(root)
    return raw.select("path", _decode(F.col("content")).alias("content"))


def parse_summary(files: DataFrame) -> DataFrame:
    """How many files of (path, content) declare a type, and how many do not."""
    code = batch(strip_comments)(F.col("content"))
    ok = F.coalesce(code.rlike(r"\b(?:class|interface|enum|record|@interface)\s+[A-Za-z_]\w*"), F.lit(False))
    return files.select(ok.alias("ok")).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


# ---- sinks
def write_graph(nodes: DataFrame, path: str) -> None:
    """Nodes partitioned by project and run; a rerun replaces only the partitions it writes."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "run_id").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str], force: bool = False) -> None:
    """Rows whose key the store has not yet are appended; with ``force`` the store is replaced."""
    spark = df.sparkSession
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if exists and not force:
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("overwrite" if force else "append").parquet(path)


def write_csv(df: DataFrame, path: str, joiner: str = ";") -> None:
    """A CSV with header; lists become joined text."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    df.select(*[F.array_join(F.col(c).cast("array<string>"), joiner).alias(c) if c in lists else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(results: DataFrame, keys: list[str], path: str) -> None:
    """Totals per group under ``totals`` and the single results under ``results``, partitioned by the keys: no group's logs are gathered."""
    ok = F.coalesce("success", F.lit(False))
    results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded")).write.mode("overwrite").json(f"{path}/totals")
    results.write.mode("overwrite").partitionBy(*keys).json(f"{path}/results")


def write_round(df: DataFrame, path: str, number: int) -> None:
    """A round's rows under their own partition; a round that is repeated replaces itself."""
    df.withColumn("round", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def write_failed_logs(results: DataFrame, path: str, stem: str = "file_name") -> None:
    """Logs of failed results by their file's stem; one table, no file per row."""
    bad = results.where(~F.coalesce("success", F.lit(False)))
    bad.select(F.regexp_replace(stem, r"\.[^.]*$", "").alias("stem"), "log_output").write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a table; more than ``limit`` rows are refused rather than cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    cell = lambda v: "-" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def latex(df: DataFrame, limit: int = 1000) -> str:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    esc = lambda v: "-" if v is None else (f"{v:.2f}" if isinstance(v, float) else str(v)).replace("\\", "\\textbackslash ").replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
    return "\n".join(["\\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(map(esc, df.columns)) + " \\\\ \\hline", *(" & ".join(map(esc, r)) + " \\\\" for r in rows), "\\end{tabular}"])
