"""Stores of graphs, records and reports, and their readers. What is written reads back as it was.

All are tables of JSON lines or parquet in a folder; none writes a file per row, none gathers rows. A store that is
written again replaces itself, or only the partitions that it writes where it is partitioned.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph

RUN = ["project", "run_id"]


# ---- graphs
def write_graph(methods: DataFrame, calls: DataFrame, path: str) -> None:
    """Nodes and calls of a graph, partitioned by project; a rerun replaces the projects that it writes."""
    for name, df in (("nodes", methods), ("calls", calls)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(nodes with their layers, calls) of a stored graph: calls are resolved and layers computed anew, links between rows are never stored."""
    nodes, calls = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/calls")
    lay = callgraph.built_graph(spark, calls, nodes, order).select(*RUN, F.col("node").alias("method_key"), F.col("layer").alias("new_layer"))
    return nodes.join(lay, [*RUN, "method_key"], "left"), calls


def write_nodes(df: DataFrame, path: str) -> None:
    """A node store in columns; nothing that is read back can run code, as pickles could."""
    df.write.mode("overwrite").parquet(path)


def translated_headers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header records of JSON lines: those with a translated class name and methods; broken lines are left out."""
    x = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return x.where("_corrupt_record is null and translated_class_name is not null and methods is not null").drop("_corrupt_record")


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, record) of one JSON text per file; a broken one gives a null record, one without bytes and a missing folder no rows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"path string, record struct<{schema}>")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    text = F.decode("content", "utf-8")
    return raw.select("path", F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).alias("record"))


# ---- records and reports
def write_records(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Records with the columns of ``like``."""
    return spark.read.schema(like.schema).json(path)


def rewrite_sorted(df: DataFrame, path: str, key: str) -> None:
    """A keyed store written anew in the order of its key, over range partitions: file after file holds the keys in order."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def iteration_report(feedback: DataFrame) -> DataFrame:
    """Per run and round: headers checked, succeeded, failed by themselves, blocked by others; the sum of both flags may pass the failures."""
    ok = F.coalesce("success", F.lit(False))
    flag = lambda c: F.count_if(~ok & F.coalesce(c, F.lit(False)))
    return feedback.groupBy(*RUN, "round").agg(F.countDistinct("header_key").alias("n_headers"), F.count_if(ok).alias("n_ok"), flag("has_local_issues").alias("n_local"), flag("blocked_by_dependency").alias("n_blocked"))


def mapping_report(methods: DataFrame) -> DataFrame:
    """Per header its methods by mapping status, as a map, and the share that needs no more work."""
    n = methods.groupBy(*RUN, "header_key", F.coalesce("mapping_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    done = F.sum(F.when(F.col("status").isin("already_implemented", "pure_virtual", "defaulted_or_deleted", "deleted_or_merged"), F.col("n")).otherwise(0))
    return n.groupBy(*RUN, "header_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("n_methods"), done.alias("n_done"))  # a map as long as there are statuses


def repair_stats(results: DataFrame) -> DataFrame:
    """Per run: files repaired, given up and never tried, of recorded attempts (file_name, success, attempts)."""
    ok = F.coalesce("success", F.lit(False))
    x = results.groupBy(*RUN, "file_name").agg(F.bool_or(ok).alias("ok"), F.count(F.lit(1)).alias("attempts"))
    return x.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("ok").alias("n_repaired"), F.count_if(~F.col("ok")).alias("n_open"), F.sum("attempts").alias("n_attempts"))


def cycle_report(cycles: DataFrame, links: DataFrame) -> DataFrame:
    """Per run whether its graph has cycles, how many were found and the longest."""
    c = cycles.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_cycles"), F.max("length").alias("longest"))
    e = links.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_edges"))
    return e.join(c, RUN, "left").select(*RUN, "n_edges", F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("n_cycles").isNotNull().alias("has_cycle"))


# ---- settings of the driver
REQUIRED = ("api_key", "base_url", "model")


def provider_configs(inline: str | None = None, file: str | None = None, required: tuple[str, ...] = REQUIRED) -> dict[str, dict]:
    """Model settings by name from a JSON text, else from a file, else none; settings that lack a required field are an error."""
    if inline and inline.strip():
        raw = json.loads(inline)
    elif file and file.strip():
        with open(os.path.expanduser(file), encoding="utf-8") as f:
            raw = json.load(f)
    else:
        return {}
    if not isinstance(raw, dict):
        raise ValueError("settings must be a JSON object")
    for name, config in raw.items():
        missing = [k for k in required if not isinstance(config, dict) or not str(config.get(k, "")).strip()]
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
    return {str(k): dict(v) for k, v in raw.items()}
