"""Round trips through the stores, each beside what it must equal in SQL. They write to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import callgraph, contexts
from ..sources import stores
from ..tables import Stage, load, shared_dir
from . import core_queries as core
from .core_queries import RUN, SQL, query
from .graph_queries import _calls, _methods


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@query(SQL["graph_build"].replace("AS component_size, ", "AS component_size_, ").replace("SELECT n.project, n.run_id, n.node, CAST(coalesce(l.size, 1) AS INTEGER) AS component_size_, ", "SELECT n.project, n.run_id, n.node, "))
def graph_round_trip(spark, sf):
    """A stored graph read back, its calls resolved and its layers computed anew."""
    path = _folder(spark, "graph")
    stores.write_graph(_methods(spark, sf), _calls(spark, sf), path)
    nodes, _ = stores.read_graph(spark, path)
    return nodes.where("method_key is not null").select(*RUN, F.col("method_key").alias("node"), F.col("new_layer").alias("layer")).distinct()


@query("SELECT method_id, method_key, layer, is_simple_method FROM methods")
def node_round_trip(spark, sf):
    path = _folder(spark, "nodes")
    stores.write_nodes(load(spark, sf, "methods", "method_id", "method_key", "layer", "is_simple_method"), path)
    return spark.read.parquet(path)


@query(SQL["eval_records"])
def eval_round_trip(spark, sf):
    """The nested records of all headers, written and read back."""
    r = contexts.eval_records(load(spark, sf, "headers", *RUN, "ai", "header_key", "include_dependencies"), load(spark, sf, "methods", *RUN, "header_key", "method_key", "code"))
    path = _folder(spark, "eval")
    stores.write_records(r, path)
    x = stores.read_records(spark, path, r)
    return x.select(*RUN, "header_key", "ai", "file_name", F.array_join("includes", ";").alias("includes"), F.array_join("functions.signature", ";").alias("functions"), F.size("functions").cast("long").alias("n_functions"))


@query("SELECT feedback_id, project, run_id, round FROM compile_feedback")
def sorted_round_trip(spark, sf):
    path = _folder(spark, "sorted")
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "round")
    stores.rewrite_sorted(f, path, "feedback_id")
    return stores.read_records(spark, path, f)


@query("SELECT header_id, header_key, translated_class_name FROM headers WHERE translated_class_name IS NOT NULL AND imports IS NOT NULL")
def translated_round_trip(spark, sf):
    """Header records with a class name and members; others in the store are passed over."""
    path = _folder(spark, "headers")
    h = load(spark, sf, "headers", "header_id", "header_key", "translated_class_name", F.col("imports").alias("methods"))
    stores.write_records(h, path)
    h.sparkSession.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return stores.translated_headers(spark, path, "header_id long, header_key string, translated_class_name string, methods array<string>").drop("methods")


@query("SELECT project, run_id, round, count(DISTINCT header_key) AS n_headers, count(*) FILTER (coalesce(success, false)) AS n_ok, count(*) FILTER (NOT coalesce(success, false) AND coalesce(has_local_issues, false)) AS n_local, count(*) FILTER (NOT coalesce(success, false) AND coalesce(blocked_by_dependency, false)) AS n_blocked FROM compile_feedback GROUP BY project, run_id, round")
def iteration_report(spark, sf):
    r = stores.iteration_report(load(spark, sf, "compile_feedback", *RUN, "round", "header_key", "success", "has_local_issues", "blocked_by_dependency"))
    path = _folder(spark, "iterations")
    stores.write_records(r, path)
    return stores.read_records(spark, path, r)


@query("SELECT project, run_id, header_key, count(*) AS n_methods, count(*) FILTER (mapping_status IN ('already_implemented', 'pure_virtual', 'defaulted_or_deleted', 'deleted_or_merged')) AS n_done, count(DISTINCT coalesce(mapping_status, 'none')) AS n_statuses, count(*) FILTER (mapping_status = 'needs_cpp_body') AS n_needs_cpp FROM methods GROUP BY project, run_id, header_key")
def mapping_report(spark, sf):
    r = stores.mapping_report(load(spark, sf, "methods", *RUN, "header_key", "mapping_status"))
    path = _folder(spark, "mappings")
    stores.write_records(r, path)
    x = stores.read_records(spark, path, r)
    return x.select(*RUN, "header_key", "n_methods", "n_done", F.size("statuses").cast("long").alias("n_statuses"), F.coalesce(F.try_element_at("statuses", F.lit("needs_cpp_body")), F.lit(0)).alias("n_needs_cpp"))


@query("WITH f AS (SELECT project, run_id, file_name, bool_or(coalesce(success, false)) AS ok, count(*) AS attempts FROM compile_result GROUP BY ALL) SELECT project, run_id, count(*) AS n_files, count(*) FILTER (ok) AS n_repaired, count(*) FILTER (NOT ok) AS n_open, CAST(sum(attempts) AS BIGINT) AS n_attempts FROM f GROUP BY project, run_id")
def repair_report(spark, sf):
    r = stores.repair_stats(load(spark, sf, "compile_result", *RUN, "file_name", "success"))
    path = _folder(spark, "repairs")
    stores.write_records(r, path)
    return stores.read_records(spark, path, r)


@query(SQL["import_cycle_summary"].replace("SELECT project, run_id, count(*) AS n_types, ", "SELECT project, run_id, ").replace(", count(*) FILTER (size > 1) AS n_on_cycles", ""))
def cycle_report(spark, sf):
    """The report on each run's import cycles; the cycles found themselves are in ``import_cycles``."""
    e = Stage(spark, "imports").put(core.import_edges(spark, sf).select(*RUN, F.col("header_key").alias("src"), F.col("target").alias("dst")).distinct())
    r = stores.cycle_report(callgraph.component_cycles(spark, e), e)
    path = _folder(spark, "cycles")
    stores.write_records(r, path)
    return stores.read_records(spark, path, r).select(*RUN, "n_edges", "has_cycle")
