"""Queries over the experiment's tables, each beside the same question in SQL.

``Q`` holds functions of (spark, sf_dir), ``SQL`` the ANSI text that another engine answers on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text
from ..operators import callgraph, ledger, metrics, rounds
from ..tables import Stage, load
from . import class_sql

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        Q[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def L(c: str) -> str:  # noqa: N802
    """A text without a carriage return and outer blanks, in SQL."""
    return f"trim(replace({c}, chr(13), ''))"


RUN = ["project", "run_id"]

# ------------------------------------------------------------------ diagnostics
_LINES = f"""
  lines AS (
    SELECT project, ai, run_id, file_name, trim(regexp_replace(trim(regexp_extract({L("u.line")}, '(?:fatal\\s+)?error:\\s*(.+?)\\s*$', 1)), '\\s*\\[-[^\\]]+\\]\\s*$', '')) AS msg
    FROM (SELECT project, ai, run_id, file_name, unnest(string_split(log_output, chr(10))) AS line FROM compile_result WHERE NOT coalesce(success, true)) u),
  msgs AS (SELECT *, {class_sql.classes("msg")} AS error_type FROM lines WHERE msg <> '' AND NOT contains(msg, 'too many errors emitted')),
  roots AS (SELECT *, bool_or(contains(lower(msg), 'file not found') OR contains(lower(msg), '#include nested too deeply')) OVER (PARTITION BY project, run_id, file_name) AS root FROM msgs),
  kept AS (SELECT DISTINCT project, ai, run_id, file_name, error_type, substr(msg, 1, 200) AS detail FROM roots
    WHERE NOT (root AND error_type <> 'Header File Error' AND {class_sql.cascade("msg")}))
"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Failed results' error messages with their class; a missing success counts as success."""
    r = load(spark, sf, "compile_result", "project", "ai", "run_id", "file_name", "success", "log_output").where(~F.coalesce("success", F.lit(True)))
    m = r.select("project", "ai", "run_id", "file_name", F.explode(rules.error_lines(F.col("log_output"))).alias("msg"))
    return m.withColumn("error_type", rules.classify(F.col("msg")))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (class, first 200 characters) per file, without what follows from a missing header."""
    m = messages(spark, sf)
    root = F.max(rules.header_root(F.col("msg"))).over(Window.partitionBy("project", "run_id", "file_name"))
    kept = m.withColumn("root", root).where(~(F.col("root") & rules.cascade(F.col("msg"), F.col("error_type"))))
    return kept.select("project", "ai", "run_id", "file_name", "error_type", F.substring("msg", 1, 200).alias("detail")).distinct()


@query(f"WITH {_LINES} SELECT ai, " + ", ".join(f"count(*) FILTER (error_type = '{t}') AS n_{t.lower().replace(' ', '_')}" for t in rules.ERROR_TYPES) + ", count(DISTINCT project || '|' || run_id || '|' || file_name) AS n_files FROM kept GROUP BY ai")
def error_class_pivot(spark, sf):
    k = classified(spark, sf)
    return k.groupBy("ai").agg(*[F.count_if(F.col("error_type") == t).alias(f"n_{t.lower().replace(' ', '_')}") for t in rules.ERROR_TYPES], F.countDistinct("project", "run_id", "file_name").alias("n_files"))


@query(f"WITH {_LINES} SELECT coalesce(project, 'all') AS project, error_type, count(*) AS n FROM kept GROUP BY GROUPING SETS ((project, error_type), (error_type))")
def error_class_counts(spark, sf):
    k = classified(spark, sf).groupingSets([["project", "error_type"], ["error_type"]], "project", "error_type").agg(F.count(F.lit(1)).alias("n"))
    return k.select(F.coalesce("project", F.lit("all")).alias("project"), "error_type", "n")


@query(f"WITH {_LINES} SELECT * FROM kept")
def error_details(spark, sf):
    return classified(spark, sf)


@query(f"WITH {_LINES} SELECT error_type, count(*) AS n_messages, count(DISTINCT msg) AS n_distinct FROM (SELECT DISTINCT project, ai, run_id, file_name, error_type, msg FROM msgs) x GROUP BY error_type")
def error_messages_by_class(spark, sf):
    m = messages(spark, sf).distinct()
    return m.groupBy("error_type").agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("msg").alias("n_distinct"))


@query(f"WITH {_LINES} SELECT project, run_id, file_name, count(*) AS n_cascade FROM (SELECT DISTINCT * FROM roots) r WHERE root AND error_type <> 'Header File Error' AND {class_sql.cascade("msg")} GROUP BY ALL")
def cascade_suppressed(spark, sf):
    m = messages(spark, sf).distinct()
    root = F.max(rules.header_root(F.col("msg"))).over(Window.partitionBy("project", "run_id", "file_name"))
    return m.withColumn("root", root).where(F.col("root") & rules.cascade(F.col("msg"), F.col("error_type"))).groupBy("project", "run_id", "file_name").agg(F.count(F.lit(1)).alias("n_cascade"))


def _error_share_sql() -> str:
    return f"WITH {_LINES}, c AS (SELECT ai, error_type, count(*) AS n FROM kept GROUP BY ALL) SELECT ai, error_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY ai), 6) AS pct FROM c"


@query(_error_share_sql())
def error_share_by_model(spark, sf):
    c = classified(spark, sf).groupBy("ai", "error_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("ai")), 6))


_BLOCKS = f"blocks AS (SELECT feedback_id, project, ai, run_id, header_key, round, unnest(diagnostic_blocks) AS block FROM compile_feedback), issues AS (SELECT *, {class_sql.issues("block")} AS types FROM blocks WHERE block IS NOT NULL)"


def blocks(spark, sf):
    f = load(spark, sf, "compile_feedback", "feedback_id", "project", "ai", "run_id", "header_key", "round", "diagnostic_blocks")
    return f.select("feedback_id", "project", "ai", "run_id", "header_key", "round", F.explode("diagnostic_blocks").alias("block")).where("block is not null").withColumn("types", rules.issue_types(F.col("block")))


@query(f"WITH {_BLOCKS} SELECT t AS issue_type, count(*) AS n FROM (SELECT unnest(types) AS t FROM issues) x GROUP BY t")
def issue_type_counts(spark, sf):
    return blocks(spark, sf).select(F.explode("types").alias("issue_type")).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BLOCKS} SELECT DISTINCT feedback_id, unnest(types) AS issue_type, substr(regexp_replace(block, '\\s+', ' ', 'g'), 1, 240) AS detail FROM issues")
def issues_normalized(spark, sf):
    b = blocks(spark, sf)
    return b.select("feedback_id", F.explode("types").alias("issue_type"), F.substring(F.regexp_replace("block", r"\s+", " "), 1, 240).alias("detail")).distinct()


@query(f"WITH {_BLOCKS} SELECT project, run_id, header_key, round, string_agg(DISTINCT t, ';' ORDER BY t) AS issue_types, count(*) AS n_issues FROM (SELECT DISTINCT project, run_id, header_key, round, block, unnest(types) AS t FROM issues) x GROUP BY ALL")
def feedback_rollup(spark, sf):
    x = blocks(spark, sf).select("project", "run_id", "header_key", "round", "block", F.explode("types").alias("t")).distinct()
    return x.groupBy("project", "run_id", "header_key", "round").agg(F.array_join(F.sort_array(F.collect_set("t")), ";").alias("issue_types"), F.count(F.lit(1)).alias("n_issues"))


_LOC = r"^\s*([^\s:][^:]*):(\d+):(\d+):\s*(?:fatal )?error:"


@query(f"""WITH l AS (SELECT result_id, unnest(string_split(log_output, chr(10))) AS line FROM compile_result)
  SELECT DISTINCT result_id, regexp_extract(line, '{_LOC}', 1) AS file_path, CAST(regexp_extract(line, '{_LOC}', 2) AS INTEGER) AS line_no, CAST(regexp_extract(line, '{_LOC}', 3) AS INTEGER) AS col_no FROM l WHERE regexp_matches(line, '{_LOC}')""")
def error_locations(spark, sf):
    lines = load(spark, sf, "compile_result", "result_id", "log_output").select("result_id", F.explode(F.split("log_output", "\n")).alias("line")).where(F.col("line").rlike(_LOC))
    loc = text.error_location(F.col("line"))
    return lines.select("result_id", loc.alias("l")).select("result_id", "l.file_path", F.col("l.line").alias("line_no"), F.col("l.column").alias("col_no")).distinct()


@query("""WITH l AS (SELECT project, unnest(string_split(log_output, chr(10))) AS line FROM compile_result)
  SELECT regexp_extract(line, 'fatal error: ''([^'']+)'' file not found', 1) AS include_name, count(*) AS n, count(DISTINCT project) AS n_projects FROM l WHERE regexp_matches(line, 'fatal error: ''([^'']+)'' file not found') GROUP BY 1""")
def missing_includes(spark, sf):
    lines = load(spark, sf, "compile_result", "project", "log_output").select("project", F.explode(F.split("log_output", "\n")).alias("line"))
    m = lines.withColumn("include_name", text.missing_include(F.col("line"))).where("line rlike \"fatal error: '([^']+)' file not found\"")
    return m.groupBy("include_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project").alias("n_projects"))


@query("SELECT result_id, CASE WHEN length(log_output) > 500 THEN rtrim(substr(log_output, 1, 500)) || '... [cut]' ELSE log_output END AS short_log, len(string_split(log_output, chr(10))) AS n_lines, array_to_string(list_slice(string_split(log_output, chr(10)), 1, 3), chr(10)) AS head FROM compile_result WHERE log_output IS NOT NULL")
def truncated_logs(spark, sf):
    r = load(spark, sf, "compile_result", "result_id", "log_output").where("log_output is not null")
    lines = F.split("log_output", "\n")
    return r.select("result_id", F.when(F.length("log_output") > 500, F.concat(F.rtrim(F.substring("log_output", 1, 500)), F.lit("... [cut]"))).otherwise(F.col("log_output")).alias("short_log"), F.size(lines).cast("long").alias("n_lines"), F.array_join(F.slice(lines, 1, 3), "\n").alias("head"))


@query("""WITH l AS (SELECT result_id, line, i FROM (SELECT result_id, unnest(string_split(log_output, chr(10))) AS line, generate_subscripts(string_split(log_output, chr(10)), 1) AS i FROM compile_result WHERE log_output <> '') x),
  t AS (SELECT *, CASE WHEN contains(lower(line), 'error') THEN 0 WHEN contains(lower(line), 'warning') THEN 1 ELSE 2 END AS tier FROM l)
  SELECT result_id, tier, min(i) AS line_no FROM (SELECT *, min(tier) OVER (PARTITION BY result_id) AS best FROM t) y WHERE tier = best GROUP BY result_id, tier""")
def severity_target(spark, sf):
    """The first line of the worst severity of each log."""
    r = load(spark, sf, "compile_result", "result_id", "log_output").where("log_output <> ''")
    x = r.select("result_id", F.posexplode(F.split("log_output", "\n")).alias("pos", "line"))
    tier = F.when(F.lower("line").contains("error"), 0).when(F.lower("line").contains("warning"), 1).otherwise(2)
    return x.groupBy("result_id").agg(F.min(F.struct(tier.alias("tier"), (F.col("pos") + 1).cast("long").alias("line_no"))).alias("m")).select("result_id", "m.tier", "m.line_no")


# ------------------------------------------------------------------ rates and averages
@query("SELECT project, count(*) AS n, count(*) FILTER (coalesce(success, true)) AS n_ok, round(coalesce(count(*) FILTER (coalesce(success, true)) / nullif(count(*), 0)::DOUBLE, 0), 6) AS rate FROM compile_result WHERE kind = 'cpp' GROUP BY project")
def rate_cpp_files(spark, sf):
    r = load(spark, sf, "compile_result", "project", "kind", "success").where("kind = 'cpp'")
    ok = metrics.as_flag(F.col("success"), True)
    return r.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.round(metrics.rate(ok, empty=0.0), 6).alias("rate"))


def _rate_sql(missing: str, empty: str) -> str:
    r = f"count(*) FILTER (stage = 'post' AND kind = 'cpp' AND coalesce(success, {missing})) / nullif(count(*) FILTER (stage = 'post' AND kind = 'cpp'), 0)::DOUBLE"
    return f"SELECT project, run_id, ai, round({r if empty == 'NULL' else f'coalesce({r}, {empty})'}, 6) AS rate FROM compile_result GROUP BY ALL"


def _rate(missing: bool, empty: float | None):
    def run(spark, sf):
        r = load(spark, sf, "compile_result", *RUN, "ai", "stage", "kind", "success")
        return r.groupBy(*RUN, "ai").agg(F.round(metrics.rate(metrics.as_flag(F.col("success"), missing), (F.col("stage") == "post") & (F.col("kind") == "cpp"), empty), 6).alias("rate"))

    return run


for _n, _m, _e in (("zero", True, 0.0), ("one", False, 1.0), ("null", False, None)):
    query(_rate_sql(str(_m).lower(), "NULL" if _e is None else str(_e)), f"rate_empty_{_n}")(_rate(_m, _e))


@query("SELECT project, ai, count(*) AS n_files, count(*) FILTER (all_ok) AS n_ok, round(100.0 * count(*) FILTER (all_ok) / count(*), 2) AS pct FROM (SELECT project, ai, run_id, file_name, bool_and(coalesce(success, true)) AS all_ok FROM compile_result GROUP BY ALL) x GROUP BY ALL")
def bool_and_rollup(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "ai", "file_name", "success")
    f = r.groupBy("project", "ai", "run_id", "file_name").agg(F.bool_and(metrics.as_flag(F.col("success"), True)).alias("all_ok"))
    return f.groupBy("project", "ai").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("all_ok").alias("n_ok"), metrics.percent(F.count_if("all_ok"), F.count(F.lit(1))).alias("pct"))


_PER = "per AS (SELECT project, run_id, ai, stage, count(*) FILTER (success) AS ok, count(success) AS total, sum(elapsed_seconds) AS secs FROM compile_result GROUP BY ALL)"


def per_run(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "ai", "stage", "success", "elapsed_seconds")
    return r.groupBy(*RUN, "ai", "stage").agg(F.count_if("success").alias("ok"), F.count("success").alias("total"), F.sum("elapsed_seconds").alias("secs"))


@query(f"WITH {_PER} SELECT ai, stage, round(sum(ok) / nullif(sum(total), 0)::DOUBLE, 6) AS micro, round(avg(CASE WHEN total > 0 THEN ok / total::DOUBLE END), 6) AS macro, count(*) FILTER (total = 0) AS n_unmeasured FROM per GROUP BY ALL")
def micro_macro_by_strategy(spark, sf):
    p = per_run(spark, sf)
    return p.groupBy("ai", "stage").agg(F.round(metrics.micro(F.col("ok"), F.col("total")), 6).alias("micro"), F.round(metrics.macro(F.when(F.col("total") > 0, F.col("ok") / F.col("total"))), 6).alias("macro"), F.count_if(F.col("total") == 0).alias("n_unmeasured"))


@query("SELECT m.ai, round(sum(CASE WHEN mapping_status IN ('already_implemented', 'pure_virtual') THEN loc ELSE 0 END) / nullif(sum(loc), 0)::DOUBLE, 6) AS weighted_rate, round(avg(CASE WHEN mapping_status IN ('already_implemented', 'pure_virtual') THEN 1.0 ELSE 0.0 END), 6) AS count_rate, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT ai, mapping_status, len(list_filter(string_split(code, chr(10)), lambda x: trim(replace(replace(x, chr(13), ''), chr(9), '')) <> '')) AS loc FROM methods WHERE code IS NOT NULL) m GROUP BY m.ai")
def weighted_rate(spark, sf):
    m = load(spark, sf, "methods", "ai", "mapping_status", "code").where("code is not null")
    loc = F.size(F.filter(F.split("code", "\n"), lambda x: F.trim(F.translate(x, "\r\t", "")) != "")).cast("long")
    m = m.select("ai", F.col("mapping_status").isin("already_implemented", "pure_virtual").alias("done"), loc.alias("loc"))
    done = F.coalesce("done", F.lit(False))
    return m.groupBy("ai").agg(F.round(metrics.weighted(done, F.col("loc")), 6).alias("weighted_rate"), F.round(F.avg(done.cast("double")), 6).alias("count_rate"), F.sum("loc").alias("loc"))


@query("SELECT coalesce(ai, 'all') AS ai, coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(CASE WHEN coalesce(success, false) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM compile_result GROUP BY GROUPING SETS ((ai, kind), (ai), ())")
def grouping_sets_total(spark, sf):
    r = load(spark, sf, "compile_result", "ai", "kind", "success").withColumn("ok", metrics.as_flag(F.col("success"), False).cast("double"))
    g = r.groupingSets([["ai", "kind"], ["ai"], []], "ai", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("rate"))
    return g.select(F.coalesce("ai", F.lit("all")).alias("ai"), F.coalesce("kind", F.lit("all")).alias("kind"), "n", "rate")


@query("SELECT stage, kind, round(sum(elapsed_seconds), 3) AS secs, round(sum(elapsed_seconds) / sum(sum(elapsed_seconds)) OVER (), 6) AS share FROM compile_result GROUP BY stage, kind")
def share_of_total(spark, sf):
    s = load(spark, sf, "compile_result", "stage", "kind", "elapsed_seconds").groupBy("stage", "kind").agg(F.sum("elapsed_seconds").alias("s"))
    whole = F.sum("s").over(Window.partitionBy(F.lit(1)))
    return s.select("stage", "kind", F.round("s", 3).alias("secs"), F.round(F.col("s") / whole, 6).alias("share"))


@query("SELECT project, " + ", ".join(f"round(avg(elapsed_seconds) FILTER (ai = '{a}'), 6) AS mean_{a.replace('-', '_')}" for a in ("quill-large", "tundra-7", "marlow-coder", "osprey-mini", "linden-chat", "vesper-pro")) + " FROM compile_result GROUP BY project")
def pivot_mean(spark, sf):
    r = load(spark, sf, "compile_result", "project", "ai", "elapsed_seconds")
    models = ("quill-large", "tundra-7", "marlow-coder", "osprey-mini", "linden-chat", "vesper-pro")
    return r.groupBy("project").agg(*[F.round(F.avg(F.when(F.col("ai") == a, F.col("elapsed_seconds"))), 6).alias(f"mean_{a.replace('-', '_')}") for a in models])


@query("SELECT project, round(avg(CASE WHEN coalesce(success, false) THEN 1.0 ELSE 0.0 END) FILTER (stage = 'post') - avg(CASE WHEN coalesce(success, false) THEN 1.0 ELSE 0.0 END) FILTER (stage = 'pre'), 6) AS delta FROM compile_result GROUP BY project")
def pivot_delta(spark, sf):
    r = load(spark, sf, "compile_result", "project", "stage", "success").withColumn("ok", metrics.as_flag(F.col("success"), False).cast("double"))
    mean = lambda s: F.avg(F.when(F.col("stage") == s, F.col("ok")))
    return r.groupBy("project").agg(F.round(mean("post") - mean("pre"), 6).alias("delta"))


@query("""WITH w AS (SELECT ai, count(*) FILTER (stage = 'pre') AS pre, count(*) FILTER (stage = 'post') AS post, count(*) FILTER (coalesce(success, false)) AS ok FROM compile_result GROUP BY ai)
  SELECT ai, measure, n FROM (SELECT ai, 'pre' AS measure, pre AS n FROM w UNION ALL SELECT ai, 'post', post FROM w UNION ALL SELECT ai, 'ok', ok FROM w) u""")
def unpivot_long(spark, sf):
    r = load(spark, sf, "compile_result", "ai", "stage", "success")
    w = r.groupBy("ai").agg(F.count_if(F.col("stage") == "pre").alias("pre"), F.count_if(F.col("stage") == "post").alias("post"), F.count_if(metrics.as_flag(F.col("success"), False)).alias("ok"))
    return metrics.unpivot(w, ["ai"], ["pre", "post", "ok"], "measure", "n")


@query("""WITH s AS (SELECT project, ai, round(avg(CASE WHEN coalesce(success, false) THEN 1.0 ELSE 0.0 END), 3) AS score FROM compile_result GROUP BY ALL),
  b AS (SELECT project, max(score) AS best_score FROM s GROUP BY project)
  SELECT s.project, b.best_score, min(s.ai) AS best_choice, string_agg(s.ai, ';' ORDER BY s.ai) AS ties FROM s JOIN b USING (project) WHERE s.score = b.best_score GROUP BY ALL""")
def best_with_ties(spark, sf):
    r = load(spark, sf, "compile_result", "project", "ai", "success")
    s = r.groupBy("project", "ai").agg(F.round(F.avg(metrics.as_flag(F.col("success"), False).cast("double")), 3).alias("score"))
    return metrics.best_with_ties(s, ["project"], "ai", "score")


@query("""WITH d AS (SELECT DISTINCT ai FROM compile_result WHERE ai IS NOT NULL), e AS (SELECT DISTINCT stage FROM compile_result WHERE stage IS NOT NULL), k AS (SELECT DISTINCT kind FROM compile_result WHERE kind IS NOT NULL)
  SELECT d.ai, e.stage, k.kind, count(r.result_id) AS n FROM d CROSS JOIN e CROSS JOIN k LEFT JOIN compile_result r ON r.ai = d.ai AND r.stage = e.stage AND r.kind = k.kind GROUP BY ALL""")
def fixed_grid_reindex(spark, sf):
    r = load(spark, sf, "compile_result", "ai", "stage", "kind")
    n = r.groupBy("ai", "stage", "kind").agg(F.count(F.lit(1)).alias("n"))
    dims = [n.select(c).where(F.col(c).isNotNull()).distinct() for c in ("ai", "stage", "kind")]
    return metrics.on_grid(n, dims, ["ai", "stage", "kind"], {"n": 0}).select("ai", "stage", "kind", "n")


@query("SELECT ai, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS loc, round(avg(loc), 6) AS mean_loc, max(loc) AS max_loc, round(quantile_cont(loc, 0.5), 6) AS median_loc FROM (SELECT ai, CAST(len(string_split(source_code, chr(10))) AS BIGINT) AS loc FROM headers WHERE source_code IS NOT NULL) x GROUP BY ai")
def dataset_info(spark, sf):
    h = load(spark, sf, "headers", "ai", "source_code").where("source_code is not null").select("ai", F.size(F.split("source_code", "\n")).cast("long").alias("loc"))
    return h.groupBy("ai").agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc"), F.round(F.avg("loc"), 6).alias("mean_loc"), F.max("loc").alias("max_loc"), F.round(F.expr("percentile(loc, 0.5)"), 6).alias("median_loc"))


@query("""WITH h AS (SELECT project, count(*) AS n_headers, CAST(sum(length(coalesce(source_code, ''))) AS BIGINT) AS header_chars FROM headers GROUP BY project), m AS (SELECT project, count(*) AS n_methods, CAST(sum(length(coalesce(code, ''))) AS BIGINT) AS method_chars, count(*) FILTER (is_simple_method) AS n_simple FROM methods GROUP BY project)
  SELECT coalesce(h.project, m.project) AS project, coalesce(n_headers, 0) AS n_headers, coalesce(header_chars, 0) AS header_chars, coalesce(n_methods, 0) AS n_methods, coalesce(method_chars, 0) AS method_chars, coalesce(n_simple, 0) AS n_simple FROM h FULL OUTER JOIN m ON h.project = m.project""")
def project_info(spark, sf):
    h = load(spark, sf, "headers", "project", "source_code").groupBy("project").agg(F.count(F.lit(1)).alias("n_headers"), F.sum(F.length(F.coalesce("source_code", F.lit("")))).alias("header_chars"))
    m = load(spark, sf, "methods", "project", "code", "is_simple_method").groupBy("project").agg(F.count(F.lit(1)).alias("n_methods"), F.sum(F.length(F.coalesce("code", F.lit("")))).alias("method_chars"), F.count_if("is_simple_method").alias("n_simple"))
    return h.join(m, "project", "full_outer").na.fill(0)


@query("SELECT run_id, project, count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (success IS NULL) AS n_missing, max(length(log_output)) AS longest_log, CAST(sum(length(log_output)) AS BIGINT) AS log_chars FROM compile_result GROUP BY ALL")
def method_rollup(spark, sf):
    r = load(spark, sf, "compile_result", "run_id", "project", "success", "log_output")
    return r.groupBy("run_id", "project").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.count_if(F.col("success").isNull()).alias("n_missing"), F.max(F.length("log_output")).cast("long").alias("longest_log"), F.sum(F.length("log_output")).alias("log_chars"))


@query("SELECT ai, record_kind, CAST(sum(n_floor) AS BIGINT) AS tokens_floor, CAST(sum(n_ceil) AS BIGINT) AS tokens_ceil, count(*) AS n_rows, count(*) FILTER (n_floor IS NULL) AS n_not_estimable FROM (SELECT ai, 'headers' AS record_kind, floor(length(raw_translated_code) / 4.0) AS n_floor, ceil(length(raw_translated_code) / 4.0) AS n_ceil FROM headers UNION ALL SELECT ai, 'methods', floor(length(raw_translated_code) / 4.0), ceil(length(raw_translated_code) / 4.0) FROM methods) x GROUP BY ALL")
def token_estimates(spark, sf):
    """Both estimates of tokens from lengths: rounded down and rounded up."""
    parts = [load(spark, sf, t, "ai", "raw_translated_code").select("ai", F.lit(t).alias("record_kind"), F.length("raw_translated_code").alias("n")) for t in ("headers", "methods")]
    x = parts[0].union(parts[1])
    return x.groupBy("ai", "record_kind").agg(F.sum(F.floor(F.col("n") / 4.0)).alias("tokens_floor"), F.sum(F.ceil(F.col("n") / 4.0)).alias("tokens_ceil"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n").isNull()).alias("n_not_estimable"))


@query("""WITH s AS (SELECT coalesce(nullif(trim(stage), ''), 'unclassified') AS stage, count(*) AS n_rows, CAST(sum(ceil(length(coalesce(log_output, '')) / 4.0)) AS BIGINT) AS tokens, round(sum(elapsed_seconds), 3) AS secs FROM compile_result GROUP BY 1)
  SELECT *, round(tokens / nullif(sum(tokens) OVER (), 0)::DOUBLE, 6) AS token_share FROM s""")
def token_stage_summary(spark, sf):
    r = load(spark, sf, "compile_result", "stage", "log_output", "elapsed_seconds")
    name = F.trim("stage")
    s = r.groupBy(F.coalesce(F.when(name != "", name), F.lit("unclassified")).alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.ceil(F.length(F.coalesce("log_output", F.lit(""))) / 4.0)).alias("tokens"), F.round(F.sum("elapsed_seconds"), 3).alias("secs"))
    return s.withColumn("token_share", F.round(metrics.ratio(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), 6))


@query("SELECT project, count(*) FILTER (total > 0) AS n_measured, count(*) FILTER (ok = 0) AS n_zero, count(*) FILTER (total = 0) AS n_missing, string_agg(run_id, ';' ORDER BY run_id) FILTER (ok = 0) AS zero_runs FROM (SELECT project, run_id, count(*) FILTER (success) AS ok, count(success) AS total FROM compile_result GROUP BY ALL) x GROUP BY project")
def paper_summary(spark, sf):
    """Measured, zero and missing runs of each project in one pass."""
    x = load(spark, sf, "compile_result", *RUN, "success").groupBy(*RUN).agg(F.count_if("success").alias("ok"), F.count("success").alias("total"))
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("ok") == 0, F.col("run_id")))), ";")
    return x.groupBy("project").agg(F.count_if(F.col("total") > 0).alias("n_measured"), F.count_if(F.col("ok") == 0).alias("n_zero"), F.count_if(F.col("total") == 0).alias("n_missing"), F.when(F.count_if(F.col("ok") == 0) > 0, names).alias("zero_runs"))


@query("SELECT stage, kind, ai, round(100.0 * count(*) FILTER (coalesce(success, false)) / count(*), 2) AS pct, printf('%.2f%%', round(100.0 * count(*) FILTER (coalesce(success, false)) / count(*), 2)) AS label FROM compile_result GROUP BY ALL")
def staged_metrics(spark, sf):
    r = load(spark, sf, "compile_result", "stage", "kind", "ai", "success")
    p = metrics.percent(F.count_if(metrics.as_flag(F.col("success"), False)), F.count(F.lit(1)))
    return r.groupBy("stage", "kind", "ai").agg(p.alias("pct")).withColumn("label", F.format_string("%.2f%%", "pct"))


# ------------------------------------------------------------------ ledgers
@query("SELECT * EXCLUDE (rn) FROM (SELECT result_id, project, run_id, stage, kind, file_name, success, elapsed_seconds, row_number() OVER (PARTITION BY project, run_id, stage, kind, file_name ORDER BY recorded_at DESC NULLS LAST, result_id DESC) AS rn FROM compile_result) x WHERE rn = 1")
def last_wins_upsert(spark, sf):
    cols = ["result_id", "project", "run_id", "stage", "kind", "file_name", "success", "elapsed_seconds"]
    r = load(spark, sf, "compile_result", *cols, "recorded_at")
    return ledger.last_wins(r, ["project", "run_id", "stage", "kind", "file_name"], ["recorded_at", "result_id"]).select(*cols)


@query("SELECT * EXCLUDE (rn) FROM (SELECT result_id, project, run_id, file_name, success, row_number() OVER (PARTITION BY project, run_id, file_name ORDER BY recorded_at DESC NULLS LAST, result_id DESC) AS rn FROM compile_result WHERE success IS NOT NULL AND log_output IS NOT NULL) x WHERE rn = 1")
def last_valid_row(spark, sf):
    """Only valid rows may win."""
    cols = ["result_id", "project", "run_id", "file_name", "success"]
    r = load(spark, sf, "compile_result", *cols, "recorded_at", "log_output")
    return ledger.last_wins(r, ["project", "run_id", "file_name"], ["recorded_at", "result_id"], F.col("success").isNotNull() & F.col("log_output").isNotNull()).select(*cols)


@query("""WITH s AS (SELECT project, run_id, count(*) FILTER (coalesce(success, false)) AS ok, count(*) AS total FROM compile_result GROUP BY ALL)
  SELECT project, best_run_id FROM (SELECT project, run_id AS best_run_id, row_number() OVER (PARTITION BY project ORDER BY ok / total::DOUBLE * 1000 + ok DESC, run_id DESC) AS rn FROM s) x WHERE rn = 1""")
def best_run(spark, sf):
    s = load(spark, sf, "compile_result", *RUN, "success").groupBy(*RUN).agg(F.count_if(metrics.as_flag(F.col("success"), False)).alias("ok"), F.count(F.lit(1)).alias("total"))
    return ledger.best_by(s, ["project"], "run_id", F.col("ok") / F.col("total") * 1000 + F.col("ok"))


@query("""WITH s AS (SELECT project, ai, run_id, count(*) FILTER (coalesce(success, false)) AS ok, count(*) AS total, max(recorded_at) AS t FROM compile_result GROUP BY ALL)
  SELECT project, ai, run_id, ok, total FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ok DESC, ok / total::DOUBLE DESC, total DESC, t DESC, run_id DESC) AS rn FROM s) x WHERE rn = 1""")
def best_project_row(spark, sf):
    s = load(spark, sf, "compile_result", *RUN, "ai", "success", "recorded_at").groupBy("project", "ai", "run_id").agg(F.count_if(metrics.as_flag(F.col("success"), False)).alias("ok"), F.count(F.lit(1)).alias("total"), F.max("recorded_at").alias("t"))
    best = s.groupBy("project").agg(F.max_by(F.struct("ai", "run_id", "ok", "total"), F.struct("ok", F.col("ok") / F.col("total"), "total", "t", "run_id")).alias("b"))
    return best.select("project", "b.*")


@query("SELECT project, max(run_id) AS latest_run_id, count(DISTINCT run_id) AS n_runs FROM headers GROUP BY project")
def latest_run(spark, sf):
    return load(spark, sf, "headers", *RUN).groupBy("project").agg(F.max("run_id").alias("latest_run_id"), F.countDistinct("run_id").alias("n_runs"))


@query("""WITH p AS (SELECT DISTINCT project FROM headers WHERE project IS NOT NULL), a AS (SELECT DISTINCT ai FROM headers WHERE ai IS NOT NULL)
  SELECT project, ai FROM p CROSS JOIN a EXCEPT SELECT project, ai FROM headers""")
def missing_cells(spark, sf):
    h = load(spark, sf, "headers", "project", "ai")
    grid = metrics.with_values(h.select("project").where("project is not null").distinct(), h.select("ai"))
    return ledger.missing_cells(grid, h, ["project", "ai"])


@query("SELECT DISTINCT h.project, h.run_id, h.header_key FROM headers h WHERE NOT EXISTS (SELECT 1 FROM compile_feedback f WHERE f.project = h.project AND f.run_id = h.run_id AND f.header_key = h.header_key AND f.success)")
def resume_pending(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key").distinct()
    done = load(spark, sf, "compile_feedback", *RUN, "header_key", "success").where("success")
    return h.join(done, [*RUN, "header_key"], "left_anti")


@query("""SELECT project, run_id, n FROM (SELECT project, run_id, count(*) AS n FROM compile_result WHERE stage = 'pre' GROUP BY ALL) b WHERE NOT EXISTS (SELECT 1 FROM compile_result u WHERE u.stage = 'post' AND u.project = b.project AND u.run_id = b.run_id)
  UNION ALL SELECT project, run_id, count(*) AS n FROM compile_result WHERE stage = 'post' GROUP BY ALL""")
def replace_slice(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "stage")
    n = lambda s: r.where(F.col("stage") == s).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    return ledger.replace_slice(n("pre"), n("post"), RUN)


@query("SELECT project, run_id, header_key, header_id, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY loaded_at, header_id) - 1 AS occurrence FROM headers")
def occurrence_index(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key", "header_id", "loaded_at")
    return ledger.occurrence_index(h, [*RUN, "header_key"], ["loaded_at", "header_id"]).select(*RUN, "header_key", "header_id", F.col("occurrence").cast("long").alias("occurrence"))


@query("SELECT project, run_id, header_key, method_id, printf('file%d.%03d', (dense_rank() OVER (PARTITION BY project, run_id ORDER BY header_key))::INTEGER, (row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY method_id) - 1)::INTEGER) AS tag FROM methods WHERE header_key IS NOT NULL")
def positional_id(spark, sf):
    m = load(spark, sf, "methods", *RUN, "header_key", "method_id").where("header_key is not null")
    no = F.dense_rank().over(Window.partitionBy(*RUN).orderBy("header_key"))
    at = F.row_number().over(Window.partitionBy(*RUN, "header_key").orderBy("method_id")) - 1
    return m.select(*RUN, "header_key", "method_id", F.format_string("file%d.%03d", no, at).alias("tag"))


@query("SELECT * EXCLUDE (rn) FROM (SELECT header_id, project, run_id, header_key, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY ord NULLS FIRST, header_id) AS rn FROM headers) x WHERE rn = 1")
def first_occurrence(spark, sf):
    h = load(spark, sf, "headers", "header_id", *RUN, "header_key", "ord")
    return ledger.first_of(h, [*RUN, "header_key"], ["ord", "header_id"]).select("header_id", *RUN, "header_key")


# ------------------------------------------------------------------ rounds
_FB = "fb AS (SELECT project, run_id, header_key, round, bool_or(coalesce(success, false)) AS success, bool_or(coalesce(has_local_issues, false)) AS has_local_issues, bool_or(coalesce(blocked_by_dependency, false)) AS blocked_by_dependency FROM compile_feedback WHERE round IS NOT NULL GROUP BY ALL)"
_KEY = ["project", "run_id", "header_key"]


def feedback(spark, sf):
    f = load(spark, sf, "compile_feedback", *_KEY, "round", "success", "has_local_issues", "blocked_by_dependency").where("round is not null")
    return f.groupBy(*_KEY, "round").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in ("success", "has_local_issues", "blocked_by_dependency")])


_STATUS = "CASE WHEN success THEN 'success' WHEN has_local_issues THEN 'local_failed' WHEN blocked_by_dependency THEN 'dependency_blocked' ELSE 'not_run' END"


@query(f"WITH {_FB} SELECT round, {_STATUS} AS status, count(*) AS n FROM fb GROUP BY ALL")
def round_status_counts(spark, sf):
    return feedback(spark, sf).groupBy("round", rounds.iteration_status().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FB} SELECT round, count(*) AS n_headers, " + ", ".join(f"count(*) FILTER ({_STATUS} = '{s}') AS n_{s}" for s in ("success", "local_failed", "dependency_blocked", "not_run")) + " FROM fb GROUP BY round")
def round_summary(spark, sf):
    f = feedback(spark, sf).withColumn("status", rounds.iteration_status())
    return f.groupBy("round").agg(F.count(F.lit(1)).alias("n_headers"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "local_failed", "dependency_blocked", "not_run")])


@query(f"WITH {_FB} SELECT k.project, k.run_id, k.header_key, r.round, coalesce({_STATUS}, 'not_run') AS status FROM (SELECT project, run_id, header_key, max(round) AS top FROM fb GROUP BY ALL) k JOIN (SELECT unnest(range(1, 100))::INTEGER AS round) r ON r.round <= k.top LEFT JOIN fb ON fb.project = k.project AND fb.run_id = k.run_id AND fb.header_key = k.header_key AND fb.round = r.round")
def round_spine(spark, sf):
    f = feedback(spark, sf)
    spine = rounds.round_spine(f, _KEY)
    return spine.join(f.withColumn("status", rounds.iteration_status()), [*_KEY, "round"], "left").select(*_KEY, "round", F.coalesce("status", F.lit("not_run")).alias("status"))


@query(f"WITH {_FB}, k AS (SELECT DISTINCT project, run_id, header_key FROM fb), s AS (SELECT k.*, r.round FROM k CROSS JOIN (SELECT unnest([1, 2, 3, 4])::INTEGER AS round) r) SELECT s.project, s.run_id, s.header_key, s.round, coalesce((SELECT fb.success FROM fb WHERE fb.project = s.project AND fb.run_id = s.run_id AND fb.header_key = s.header_key AND fb.round <= s.round ORDER BY fb.round DESC LIMIT 1), false) AS success FROM s")
def asof_status(spark, sf):
    return rounds.as_of(feedback(spark, sf), _KEY, "success", last=4, default=False)


@query(f"WITH {_FB} SELECT project, run_id, header_key, min(CASE WHEN success THEN round END) AS first_success_round, max(round) AS last_round, arg_max(success, round) AS final_success FROM fb GROUP BY ALL")
def first_success(spark, sf):
    return rounds.first_success(feedback(spark, sf), _KEY)


@query(f"WITH {_FB}, k AS (SELECT DISTINCT project, run_id, header_key FROM fb), s AS (SELECT k.*, r.round FROM k CROSS JOIN (SELECT unnest([1, 2, 3, 4])::INTEGER AS round) r), v AS (SELECT s.project, s.round, coalesce((SELECT fb.success FROM fb WHERE fb.project = s.project AND fb.run_id = s.run_id AND fb.header_key = s.header_key AND fb.round <= s.round ORDER BY fb.round DESC LIMIT 1), false) AS success FROM s) SELECT project, round, count(*) AS n_keys, count(*) FILTER (success) AS n_success, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS rate FROM v GROUP BY ALL")
def trajectory(spark, sf):
    return rounds.trajectory(feedback(spark, sf), _KEY, ["project"], 4)


@query(f"WITH {_FB}, x AS (SELECT project, run_id, header_key, min(CASE WHEN success THEN round END) AS f, arg_max(success, round) AS ok FROM fb GROUP BY ALL) SELECT project, run_id, header_key, row_number() OVER (PARTITION BY project, run_id ORDER BY CASE WHEN ok THEN 1 ELSE 0 END, f NULLS LAST, header_key) AS position FROM x")
def chart_order(spark, sf):
    x = rounds.first_success(feedback(spark, sf), _KEY)
    w = Window.partitionBy(*RUN).orderBy(F.col("final_success").cast("int"), F.col("first_success_round").asc_nulls_last(), "header_key")
    return x.select(*_KEY, F.row_number().over(w).cast("long").alias("position"))


@query(f"WITH {_FB} SELECT CAST(max_round AS INTEGER) AS rounds_used, count(*) AS n_runs, count(*) FILTER (all_ok) AS n_converged FROM (SELECT project, run_id, max(round) AS max_round, bool_and(ok) AS all_ok FROM (SELECT project, run_id, header_key, max(round) AS round, arg_max(success, round) AS ok FROM fb GROUP BY ALL) a GROUP BY ALL) b GROUP BY 1")
def rounds_used(spark, sf):
    h = rounds.first_success(feedback(spark, sf), _KEY).groupBy(*RUN).agg(F.max("last_round").alias("rounds_used"), F.bool_and("final_success").alias("all_ok"))
    return h.groupBy(F.col("rounds_used").cast("int").alias("rounds_used")).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("all_ok").alias("n_converged"))


# ------------------------------------------------------------------ joins and lookups
@query("SELECT count(*) AS n, count(*) FILTER (success) AS n_ok, r.kind FROM compile_result r WHERE EXISTS (SELECT 1 FROM headers h WHERE h.project = r.project AND h.run_id = r.run_id AND h.source_kind = 'java' AND h.header_key = regexp_replace(r.file_name, '\\.(h|cpp)$', '')) GROUP BY r.kind")
def semi_filter(spark, sf):
    """Results of files that a Java source backs."""
    r = load(spark, sf, "compile_result", *RUN, "kind", "success", "file_name").withColumn("header_key", F.regexp_replace("file_name", r"\.(h|cpp)$", ""))
    h = load(spark, sf, "headers", *RUN, "header_key", "source_kind").where("source_kind = 'java'")
    return r.join(h, [*RUN, "header_key"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"))


@query("SELECT DISTINCT r.project, r.run_id, r.file_name FROM compile_result r WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h.project = r.project AND h.run_id = r.run_id AND h.header_key = regexp_replace(r.file_name, '\\.(h|cpp)$', ''))")
def anti_missing(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "file_name").withColumn("header_key", F.regexp_replace("file_name", r"\.(h|cpp)$", ""))
    return r.join(load(spark, sf, "headers", *RUN, "header_key"), [*RUN, "header_key"], "left_anti").select(*RUN, "file_name").distinct()


@query("""WITH r AS (SELECT project, run_id, regexp_replace(file_name, '\\.(h|cpp)$', '') AS header_key, bool_and(coalesce(success, false)) AS ok FROM compile_result WHERE kind = 'header' GROUP BY ALL)
  SELECT DISTINCT h.project, h.run_id, h.header_key, coalesce(r.ok, false) AS compiled FROM headers h LEFT JOIN r USING (project, run_id, header_key)""")
def missing_counts_as_failed(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "kind", "file_name", "success").where("kind = 'header'")
    r = r.groupBy(*RUN, F.regexp_replace("file_name", r"\.(h|cpp)$", "").alias("header_key")).agg(F.bool_and(metrics.as_flag(F.col("success"), False)).alias("ok"))
    return load(spark, sf, "headers", *RUN, "header_key").distinct().join(r, [*RUN, "header_key"], "left").select(*RUN, "header_key", F.coalesce("ok", F.lit(False)).alias("compiled"))


@query("""WITH m AS (SELECT project, run_id, method_key, header_key, CASE WHEN method_body_location = 'header' THEN 'header' ELSE 'cpp' END AS kind FROM methods WHERE method_body_location IS NOT NULL),
  r AS (SELECT project, run_id, kind, regexp_replace(file_name, '\\.(h|cpp)$', '') AS header_key, bool_or(success) AS ok FROM compile_result GROUP BY ALL)
  SELECT m.kind, count(*) AS n_methods, count(*) FILTER (r.ok) AS n_compiled, count(*) FILTER (r.ok IS NULL) AS n_unknown FROM (SELECT DISTINCT * FROM m) m LEFT JOIN r ON r.project = m.project AND r.run_id = m.run_id AND r.kind = m.kind AND r.header_key = m.header_key GROUP BY m.kind""")
def artifact_results(spark, sf):
    """Each method with the result of the artefact that holds its body."""
    m = load(spark, sf, "methods", *RUN, "method_key", "header_key", "method_body_location").where("method_body_location is not null")
    m = m.select(*RUN, "method_key", "header_key", F.when(F.col("method_body_location") == "header", "header").otherwise("cpp").alias("kind")).distinct()
    r = load(spark, sf, "compile_result", *RUN, "kind", "file_name", "success").groupBy(*RUN, "kind", F.regexp_replace("file_name", r"\.(h|cpp)$", "").alias("header_key")).agg(F.bool_or("success").alias("ok"))
    return m.join(r, [*RUN, "kind", "header_key"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n_methods"), F.count_if("ok").alias("n_compiled"), F.count_if(F.col("ok").isNull()).alias("n_unknown"))


@query("""WITH a AS (SELECT project, file_name, count(*) FILTER (coalesce(success, false)) AS ok FROM compile_result WHERE stage = 'pre' GROUP BY ALL), b AS (SELECT project, file_name, count(*) FILTER (coalesce(success, false)) AS ok FROM compile_result WHERE stage = 'post' GROUP BY ALL)
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.file_name, b.file_name) AS file_name, CASE WHEN a.ok IS NULL THEN 'only_post' WHEN b.ok IS NULL THEN 'only_pre' WHEN a.ok = b.ok THEN 'same' ELSE 'differs' END AS outcome FROM a FULL OUTER JOIN b ON a.project = b.project AND a.file_name = b.file_name""")
def outer_compare(spark, sf):
    r = load(spark, sf, "compile_result", "project", "file_name", "stage", "success")
    side = lambda s, n: r.where(F.col("stage") == s).groupBy("project", "file_name").agg(F.count_if(metrics.as_flag(F.col("success"), False)).alias(n))
    j = side("pre", "a").join(side("post", "b"), ["project", "file_name"], "full_outer")
    return j.select("project", "file_name", F.when(F.col("a").isNull(), "only_post").when(F.col("b").isNull(), "only_pre").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("outcome"))


_INC = "regexp_replace(inc, '\\.(h|hpp)$', '')"


@query(f"WITH i AS (SELECT DISTINCT project, run_id, header_key, {_INC} AS target FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) x WHERE inc IS NOT NULL), k AS (SELECT DISTINCT project, run_id, replace(header_key, '$', '_') AS target, header_key AS target_key FROM headers) SELECT i.project, i.run_id, i.header_key, i.target, CASE WHEN k.target_key IS NULL THEN 'standard' ELSE 'custom' END AS include_kind FROM i LEFT JOIN k USING (project, run_id, target)")
def include_edges(spark, sf):
    """Includes matched to headers by output name; what matches none is a standard header."""
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies")
    i = h.select(*RUN, "header_key", F.explode("include_dependencies").alias("inc")).where("inc is not null").select(*RUN, "header_key", F.regexp_replace("inc", r"\.(h|hpp)$", "").alias("target")).distinct()
    k = h.select(*RUN, F.translate("header_key", "$", "_").alias("target"), F.col("header_key").alias("target_key")).distinct()
    return i.join(k, [*RUN, "target"], "left").select(*RUN, "header_key", "target", F.when(F.col("target_key").isNull(), "standard").otherwise("custom").alias("include_kind"))


@query("""WITH f AS (SELECT DISTINCT project, run_id, header_key, regexp_extract(source_code, '(?:^|\\n)\\s*package\\s+([\\w.]+)\\s*;', 1) AS pkg FROM headers WHERE source_code IS NOT NULL AND header_key IS NOT NULL),
  i AS (SELECT DISTINCT project, run_id, header_key, trim(regexp_replace(imp, '^static\\s+', '')) AS imp FROM (SELECT project, run_id, header_key, unnest(imports) AS imp FROM headers) x WHERE imp IS NOT NULL),
  n AS (SELECT project, run_id, header_key AS target, CASE WHEN pkg = '' THEN '' ELSE pkg || '.' END || replace(header_key, '$', '.') AS fqn, pkg FROM f),
  e AS (SELECT i.project, i.run_id, i.header_key, n.target, 'exact' AS how FROM i JOIN n ON n.project = i.project AND n.run_id = i.run_id AND n.fqn = i.imp
   UNION ALL SELECT i.project, i.run_id, i.header_key, n.target, 'member' FROM i JOIN n ON n.project = i.project AND n.run_id = i.run_id AND n.fqn = regexp_replace(i.imp, '\\.[^.]+$', '') AND contains(i.imp, '.')
   UNION ALL SELECT i.project, i.run_id, i.header_key, n.target, 'wildcard' FROM i JOIN n ON n.project = i.project AND n.run_id = i.run_id AND i.imp = n.pkg || '.*')
  SELECT DISTINCT * FROM e WHERE header_key <> target""")
def import_edges(spark, sf):
    """Imports to types of the run: by full name, by the type of a static member, by package."""
    h = load(spark, sf, "headers", *RUN, "header_key", "source_code", "imports")
    pkg = F.regexp_extract("source_code", r"(?:^|\n)\s*package\s+([\w.]+)\s*;", 1)
    f = h.where("source_code is not null and header_key is not null").select(*RUN, F.col("header_key").alias("target"), pkg.alias("pkg")).distinct()
    name = F.translate("target", "$", ".")
    n = f.withColumn("fqn", F.when(F.col("pkg") == "", name).otherwise(F.concat_ws(".", "pkg", name)))
    i = h.select(*RUN, "header_key", F.explode("imports").alias("imp")).where("imp is not null").select(*RUN, "header_key", F.trim(F.regexp_replace("imp", r"^static\s+", "")).alias("imp")).distinct()
    forms = F.array(F.struct(F.lit("exact").alias("how"), F.col("imp").alias("fqn")), F.when(F.col("imp").contains("."), F.struct(F.lit("member").alias("how"), F.regexp_replace("imp", r"\.[^.]+$", "").alias("fqn"))))
    by_name = i.select(*RUN, "header_key", F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("x")).select(*RUN, "header_key", "x.*").join(n.select(*RUN, "fqn", "target"), [*RUN, "fqn"])
    wild = i.where("imp like '%.*'").select(*RUN, "header_key", F.lit("wildcard").alias("how"), F.regexp_replace("imp", r"\.\*$", "").alias("pkg")).join(n.select(*RUN, "pkg", "target"), [*RUN, "pkg"])
    cols = [*RUN, "header_key", "target", "how"]
    return by_name.select(*cols).union(wild.select(*cols)).where("header_key <> target").distinct()


_NM = "regexp_extract(trim(regexp_replace(regexp_replace({c}, '<.*$', ''), '@\\w+\\s*', '', 'g')), '([A-Za-z_0-9]+)$', 1)"


@query(f"WITH p AS (SELECT DISTINCT project, run_id, header_key, {_NM.format(c='nm')} AS nm FROM (SELECT project, run_id, header_key, parent_class AS nm FROM headers UNION ALL SELECT project, run_id, header_key, unnest(interfaces) FROM headers) x WHERE nm IS NOT NULL), k AS (SELECT DISTINCT project, run_id, header_key AS parent, {_NM.format(c='header_key')} AS nm FROM headers) SELECT DISTINCT p.project, p.run_id, k.parent, p.header_key AS child FROM p JOIN k USING (project, run_id, nm) WHERE p.nm <> ''")
def inheritance_edges(spark, sf):
    nm = lambda c: F.regexp_extract(F.trim(F.regexp_replace(F.regexp_replace(c, r"<.*$", ""), r"@\w+\s*", "")), r"([A-Za-z_0-9]+)$", 1)
    h = load(spark, sf, "headers", *RUN, "header_key", "parent_class", "interfaces")
    p = h.select(*RUN, "header_key", F.explode(F.array_append(F.coalesce("interfaces", F.array().cast("array<string>")), F.col("parent_class"))).alias("raw")).where("raw is not null")
    p = p.select(*RUN, F.col("header_key").alias("child"), nm("raw").alias("nm")).where("nm <> ''").distinct()
    k = h.select(*RUN, F.col("header_key").alias("parent"), nm("header_key").alias("nm")).distinct()
    return p.join(k, [*RUN, "nm"]).select(*RUN, "parent", "child").distinct()


@query("""WITH k AS (SELECT project, run_id, method_key, min(method_id) AS id FROM methods WHERE method_key IS NOT NULL GROUP BY ALL), b AS (SELECT *, regexp_extract(method_key, '^([^:(]*)', 1) AS owner, regexp_extract(method_key, ':([^(]*)', 1) AS nm, count(*) OVER (PARTITION BY project, run_id, regexp_extract(method_key, ':([^(]*)', 1)) AS n_name FROM k)
  SELECT project, run_id, method_key, id, n_name FROM b WHERE n_name = 1""")
def unique_fallback_join(spark, sf):
    """Methods that their bare name alone identifies in a run."""
    k = load(spark, sf, "methods", *RUN, "method_key", "method_id").where("method_key is not null").groupBy(*RUN, "method_key").agg(F.min("method_id").alias("id"))
    k = k.withColumn("nm", F.regexp_extract("method_key", r":([^(]*)", 1))
    n = k.groupBy(*RUN, "nm").agg(F.count(F.lit(1)).alias("n_name")).where("n_name = 1")
    return k.join(n, [*RUN, "nm"]).select(*RUN, "method_key", "id", "n_name")


@query("""WITH m AS (SELECT project, run_id, method_key, min(method_id) AS id FROM methods WHERE method_key IS NOT NULL GROUP BY ALL),
  keys AS (SELECT project, run_id, id, method_key AS k, 1 AS pos FROM m UNION ALL SELECT project, run_id, id, regexp_extract(method_key, '([^.$:(]*:.*)$', 1), 2 FROM m UNION ALL SELECT project, run_id, id, regexp_extract(method_key, ':(.*)$', 1), 3 FROM m),
  idx AS (SELECT project, run_id, k, min(id) AS id FROM keys WHERE k <> '' GROUP BY ALL),
  probe AS (SELECT e.project, e.run_id, e.target, p.k, p.pos FROM (SELECT DISTINCT project, run_id, regexp_replace(dst, '^\\([A-Z]*\\)', '') AS target FROM call_edge) e, LATERAL (SELECT e.target AS k, 1 AS pos UNION ALL SELECT regexp_extract(e.target, '([^.$:(]*:.*)$', 1), 2 UNION ALL SELECT regexp_extract(e.target, ':(.*)$', 1), 3) p)
  SELECT p.project, p.run_id, p.target, min(p.pos) AS key_pos, arg_min(i.id, p.pos) AS method_id FROM probe p JOIN idx i USING (project, run_id, k) GROUP BY ALL""")
def precedence_lookup(spark, sf):
    """Callees found by the most specific key that any method carries."""
    m = load(spark, sf, "methods", *RUN, "method_key", "method_id").where("method_key is not null").groupBy(*RUN, "method_key").agg(F.min("method_id").alias("id"))
    parts = lambda c: F.array(F.col(c), F.regexp_extract(c, r"([^.$:(]*:.*)$", 1), F.regexp_extract(c, r":(.*)$", 1))
    idx = m.select(*RUN, "id", F.explode(F.array_distinct(parts("method_key"))).alias("k")).where("k <> ''").groupBy(*RUN, "k").agg(F.min("id").alias("id"))
    t = load(spark, sf, "call_edge", *RUN, "dst").select(*RUN, callgraph.strip_type(F.col("dst")).alias("target")).distinct()
    probe = t.select(*RUN, "target", F.posexplode(parts("target")).alias("pos", "k"))
    hit = probe.join(idx, [*RUN, "k"]).groupBy(*RUN, "target").agg(F.min(F.struct(F.col("pos"), F.col("id"))).alias("h"))
    return hit.select(*RUN, "target", (F.col("h.pos") + 1).alias("key_pos"), F.col("h.id").alias("method_id"))


@query("""WITH c AS (SELECT DISTINCT project, run_id, header_key, regexp_extract(header_key, '([^$.]*)$', 1) AS short FROM headers),
  r AS (SELECT DISTINCT project, run_id, regexp_extract(trim(parent_class), '([A-Za-z_0-9]+)$', 1) AS short FROM headers WHERE parent_class IS NOT NULL)
  SELECT r.project, r.run_id, r.short, min(c.header_key) AS header_key, count(c.header_key) AS n_candidates FROM r LEFT JOIN c USING (project, run_id, short) GROUP BY ALL""")
def name_candidates_join(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key", "parent_class")
    c = h.select(*RUN, "header_key", F.regexp_extract("header_key", r"([^$.]*)$", 1).alias("short")).distinct()
    r = h.where("parent_class is not null").select(*RUN, F.regexp_extract(F.trim("parent_class"), r"([A-Za-z_0-9]+)$", 1).alias("short")).distinct()
    return r.join(c, [*RUN, "short"], "left").groupBy(*RUN, "short").agg(F.min("header_key").alias("header_key"), F.count("header_key").alias("n_candidates"))


# ------------------------------------------------------------------ call graphs
_E = "e AS (SELECT DISTINCT project, run_id, src, regexp_replace(dst, '^\\([A-Z]*\\)', '') AS dst FROM call_edge WHERE src IS NOT NULL AND dst IS NOT NULL), k AS (SELECT DISTINCT project, run_id, method_key FROM methods WHERE method_key IS NOT NULL), o AS (SELECT e.*, a.method_key IS NOT NULL AS s, b.method_key IS NOT NULL AS d FROM e LEFT JOIN k a ON a.project = e.project AND a.run_id = e.run_id AND a.method_key = e.src LEFT JOIN k b ON b.project = e.project AND b.run_id = e.run_id AND b.method_key = e.dst WHERE e.src <> e.dst), inn AS (SELECT project, run_id, src, dst FROM o WHERE s AND d)"


def outcomes(spark, sf):
    return callgraph.resolve_edges(load(spark, sf, "call_edge", *RUN, "src", "dst"), load(spark, sf, "methods", *RUN, "method_key"))


def inner(spark, sf):
    return outcomes(spark, sf).where("outcome = 'inner'").select(*RUN, "src", "dst")


@query(f"WITH {_E} SELECT project, CASE WHEN s AND d THEN 'inner' WHEN s THEN 'external' WHEN d THEN 'caller_missing' ELSE 'both_missing' END AS outcome, count(*) AS n FROM o GROUP BY ALL")
def edge_outcomes(spark, sf):
    return outcomes(spark, sf).groupBy("project", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E} SELECT * FROM inn")
def method_edges(spark, sf):
    return inner(spark, sf)


@query(f"WITH {_E} SELECT dst AS callee, count(*) AS n_callers, count(DISTINCT project || '|' || run_id) AS n_runs FROM o WHERE s AND NOT d GROUP BY dst")
def external_callees(spark, sf):
    return outcomes(spark, sf).where("outcome = 'external'").groupBy(F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("n_callers"), F.countDistinct(*RUN).alias("n_runs"))


@query(f"WITH {_E}, d2 AS (SELECT project, run_id, node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT project, run_id, src AS node, 1 AS o, 0 AS i FROM inn UNION ALL SELECT project, run_id, dst, 0, 1 FROM inn) x GROUP BY ALL) SELECT * FROM d2")
def degree(spark, sf):
    e = inner(spark, sf)
    x = e.select(*RUN, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select(*RUN, "x.*")
    return x.groupBy(*RUN, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query(f"WITH {_E}, d2 AS (SELECT project, run_id, node, count(*) AS degree FROM (SELECT project, run_id, src AS node FROM inn UNION ALL SELECT project, run_id, dst FROM inn) x GROUP BY ALL) SELECT project, run_id, node, degree FROM d2 ORDER BY degree DESC, project, run_id, node LIMIT 20")
def topk_degree(spark, sf):
    e = inner(spark, sf)
    d = e.select(*RUN, F.explode(F.array("src", "dst")).alias("node")).groupBy(*RUN, "node").agg(F.count(F.lit(1)).alias("degree"))
    return d.orderBy(F.desc("degree"), *RUN, "node").limit(20)


@query(f"WITH {_E} SELECT DISTINCT a.project, a.run_id, a.src, b.dst FROM inn a JOIN inn b ON a.project = b.project AND a.run_id = b.run_id AND a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM inn c WHERE c.project = a.project AND c.run_id = a.run_id AND c.src = a.src AND c.dst = b.dst)")
def two_hop_related(spark, sf):
    e = inner(spark, sf)
    a, b = e.select(*RUN, "src", F.col("dst").alias("mid")), e.select(*RUN, F.col("src").alias("mid"), "dst")
    return a.join(b, [*RUN, "mid"]).where("src <> dst").select(*RUN, "src", "dst").distinct().join(e, [*RUN, "src", "dst"], "left_anti")


_R = "WITH RECURSIVE " + _E + ", r AS (SELECT project, run_id, src, dst FROM inn UNION SELECT r.project, r.run_id, r.src, i.dst FROM r JOIN inn i ON i.project = r.project AND i.run_id = r.run_id AND i.src = r.dst)"
_SCC = _R + ", nodes AS (SELECT project, run_id, src AS node FROM inn UNION SELECT project, run_id, dst FROM inn), c AS (SELECT n.project, n.run_id, n.node, least(n.node, coalesce(min(a.dst), n.node)) AS component, count(DISTINCT CASE WHEN a.dst <> n.node THEN a.dst END) + 1 AS size FROM nodes n LEFT JOIN (SELECT x.* FROM r x JOIN r y ON x.project = y.project AND x.run_id = y.run_id AND x.src = y.dst AND x.dst = y.src) a ON a.project = n.project AND a.run_id = n.run_id AND a.src = n.node GROUP BY n.project, n.run_id, n.node)"


@query(_R + " SELECT * FROM r")
def closure(spark, sf):
    """All pairs of methods of which one reaches the other."""
    from ..operators.hierarchy import hierarchies

    st = Stage(spark, "closure")
    e = st.put(inner(spark, sf))
    # numbers that a written table gives are unique, unlike hashes
    names = st.put(e.select(*RUN, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = e.join(names.withColumnsRenamed({"node": "src", "id": "parent"}), [*RUN, "src"]).join(names.withColumnsRenamed({"node": "dst", "id": "child"}), [*RUN, "dst"]).select(*RUN, "parent", "child")
    pairs = hierarchies(spark, ids).select(*RUN, F.col("node_id").alias("a"), F.explode("descendants").alias("b"))
    return pairs.join(names.withColumnsRenamed({"id": "a", "node": "src"}), [*RUN, "a"]).join(names.withColumnsRenamed({"id": "b", "node": "dst"}), [*RUN, "b"]).select(*RUN, "src", "dst")


@query(_SCC + " SELECT project, run_id, node, component, CAST(size AS INTEGER) AS component_size FROM c")
def scc(spark, sf):
    return callgraph.layers(spark, inner(spark, sf)).select(*RUN, "node", "component", "component_size")


@query(_SCC + """, ce AS (SELECT DISTINCT i.project, i.run_id, a.component AS ca, b.component AS cb FROM inn i JOIN c a ON a.project = i.project AND a.run_id = i.run_id AND a.node = i.src JOIN c b ON b.project = i.project AND b.run_id = i.run_id AND b.node = i.dst WHERE a.component <> b.component),
  lv AS (SELECT DISTINCT project, run_id, component, 0 AS lvl FROM c UNION SELECT ce.project, ce.run_id, ce.ca, lv.lvl + 1 FROM lv JOIN ce ON ce.project = lv.project AND ce.run_id = lv.run_id AND ce.cb = lv.component)
  SELECT c.project, c.run_id, c.node, CAST(max(lv.lvl) AS INTEGER) AS layer FROM c JOIN lv USING (project, run_id, component) GROUP BY ALL""")
def scc_levels(spark, sf):
    """Callees before callers; members of a cycle share a layer."""
    return callgraph.layers(spark, inner(spark, sf)).select(*RUN, "node", "layer")


@query(_R + " SELECT DISTINCT project, run_id, src AS node FROM r WHERE src = dst")
def cycle_nodes(spark, sf):
    return callgraph.layers(spark, inner(spark, sf)).where("component_size > 1").select(*RUN, "node")


@query()
def peel_layers(spark, sf):
    """Layers by peeling; what lies on or above a cycle shares the last one."""
    return callgraph.layers(spark, inner(spark, sf)).select(*RUN, "node", "peel_round")


@query("""WITH i AS (SELECT DISTINCT project, run_id, header_key AS includer, regexp_replace(inc, '\\.(h|hpp)$', '') AS target FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers WHERE source_kind <> 'generated_external') x WHERE inc IS NOT NULL)
  SELECT DISTINCT h.project, h.run_id, h.header_key FROM headers h WHERE h.source_kind = 'generated_external' AND NOT EXISTS (SELECT 1 FROM i WHERE i.project = h.project AND i.run_id = h.run_id AND i.target = replace(h.header_key, '$', '_'))""")
def isolated_generated(spark, sf):
    """Generated headers that nothing else includes; one pass, not a fix-point."""
    h = load(spark, sf, "headers", *RUN, "header_key", "source_kind", "include_dependencies")
    inc = h.where("source_kind <> 'generated_external'").select(*RUN, F.explode("include_dependencies").alias("inc")).where("inc is not null").select(*RUN, F.regexp_replace("inc", r"\.(h|hpp)$", "").alias("target")).distinct()
    gen = h.where("source_kind = 'generated_external'").select(*RUN, "header_key", F.translate("header_key", "$", "_").alias("target")).distinct()
    return gen.join(inc, [*RUN, "target"], "left_anti").select(*RUN, "header_key")


@query("SELECT project, run_id, call_type_2 AS call_type, count(*) AS raw_lines, count(DISTINCT src || '>' || dst) AS n_edges, count(*) FILTER (enabled = 0) AS n_disabled FROM (SELECT *, CASE WHEN coalesce(call_type, '') <> '' THEN call_type ELSE regexp_extract(dst, '^\\(([A-Z]*)\\)', 1) END AS call_type_2 FROM call_edge) x GROUP BY ALL")
def call_types(spark, sf):
    e = load(spark, sf, "call_edge", *RUN, "src", "dst", "call_type", "enabled")
    t = F.when(F.coalesce("call_type", F.lit("")) != "", F.col("call_type")).otherwise(F.regexp_extract("dst", r"^\(([A-Z]*)\)", 1))
    return e.groupBy(*RUN, t.alias("call_type")).agg(F.count(F.lit(1)).alias("raw_lines"), F.countDistinct(F.concat("src", F.lit(">"), "dst")).alias("n_edges"), F.count_if(F.col("enabled") == 0).alias("n_disabled"))


# ------------------------------------------------------------------ predicates, text and rules over rows
@query("SELECT method_id, (coalesce(skip_translation, false) = false AND coalesce(method_body_location, '') <> '' AND (raw_translated_code IS NULL OR trim(raw_translated_code) = '')) AS pending, coalesce(trim(raw_translated_code), '') <> '' AS translated, mapping_status IN ('needs_cpp_body', 'needs_header_body') AS needs_body, coalesce(method_body_location = 'cpp', false) AS emit_in_cpp, coalesce(method_body_location = 'header', false) AS emit_in_header FROM methods")
def work_queue(spark, sf):
    m = load(spark, sf, "methods", "method_id", "skip_translation", "method_body_location", "raw_translated_code", "mapping_status")
    done = F.coalesce(F.trim("raw_translated_code"), F.lit("")) != ""
    at = F.coalesce("method_body_location", F.lit(""))
    return m.select("method_id", ((~F.coalesce("skip_translation", F.lit(False))) & (at != "") & ~done).alias("pending"), done.alias("translated"), F.col("mapping_status").isin("needs_cpp_body", "needs_header_body").alias("needs_body"), (at == "cpp").alias("emit_in_cpp"), (at == "header").alias("emit_in_header"))


@query("SELECT project, run_id, header_key, bool_or(coalesce(method_body_location = 'cpp', false)) AS needs_cpp_file, count(*) AS n_methods FROM methods GROUP BY ALL")
def cpp_file_needed(spark, sf):
    m = load(spark, sf, "methods", *RUN, "header_key", "method_body_location")
    return m.groupBy(*RUN, "header_key").agg(F.bool_or(F.coalesce(F.col("method_body_location") == "cpp", F.lit(False))).alias("needs_cpp_file"), F.count(F.lit(1)).alias("n_methods"))


@query("SELECT header_id, CASE header_type WHEN 'class' THEN 'class ' || header_key || coalesce(' : ' || nullif(trim(parent_class), ''), '') WHEN 'interface' THEN 'interface ' || header_key WHEN 'enum' THEN 'enum ' || header_key END AS info, (source_kind = 'generated_external' OR header_type = 'generated_external') AS generated, source_kind = 'manual_stub' AS stub FROM headers")
def type_projection(spark, sf):
    h = load(spark, sf, "headers", "header_id", "header_type", "header_key", "parent_class", "source_kind")
    p = F.trim("parent_class")
    info = F.when(F.col("header_type") == "class", F.concat(F.lit("class "), "header_key", F.coalesce(F.when(p != "", F.concat(F.lit(" : "), p)), F.lit("")))).when(F.col("header_type") == "interface", F.concat(F.lit("interface "), "header_key")).when(F.col("header_type") == "enum", F.concat(F.lit("enum "), "header_key"))
    return h.select("header_id", info.alias("info"), ((F.col("source_kind") == "generated_external") | (F.col("header_type") == "generated_external")).alias("generated"), (F.col("source_kind") == "manual_stub").alias("stub"))


@query("SELECT doc_id, lower(trim(coalesce(lang, ''))) IN ('1', 'true', 'yes', 'en') AS flag, CASE doc_kind WHEN 'guide' THEN 'Guide' WHEN 'review' THEN 'Review' WHEN 'report' THEN 'Report' ELSE 'Unknown' END AS label FROM documents")
def label_map(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang", "doc_kind")
    names = F.create_map(*[F.lit(x) for x in ("guide", "Guide", "review", "Review", "report", "Report")])
    return d.select("doc_id", F.lower(F.trim(F.coalesce("lang", F.lit("")))).isin("1", "true", "yes", "en").alias("flag"), F.coalesce(F.try_element_at(names, F.coalesce("doc_kind", F.lit(""))), F.lit("Unknown")).alias("label"))


@query("SELECT method_id, regexp_extract(method_key, '^([^:]*)', 1) AS owner, regexp_extract(method_key, ':([^(]*)', 1) AS method_name, CASE WHEN regexp_extract(method_key, '\\((.*)\\)', 1) = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(regexp_extract(method_key, '\\((.*)\\)', 1), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), ',')) END AS arity, regexp_replace(method_key, '<.*?>', '', 'g') AS erased_legacy, regexp_replace(regexp_replace(regexp_replace(method_key, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g') AS erased FROM methods")
def signature_parts(spark, sf):
    m = load(spark, sf, "methods", "method_id", "method_key")
    args = F.regexp_extract("method_key", r"\((.*)\)", 1)
    return m.select(
        "method_id", F.regexp_extract("method_key", r"^([^:]*)", 1).alias("owner"), F.regexp_extract("method_key", r":([^(]*)", 1).alias("method_name"),
        F.when(args == "", 0).otherwise(F.size(F.split(text.erase_generics(args, depth=2), ","))).cast("long").alias("arity"),
        text.erase_generics(F.col("method_key"), legacy=True).alias("erased_legacy"), text.erase_generics(F.col("method_key"), depth=3).alias("erased"),
    )


@query("""WITH k AS (SELECT DISTINCT method_key AS k FROM methods WHERE contains(method_key, ':')),
  p AS (SELECT k, regexp_extract(split_part(k, ':', 1), '([^.]*)$', 1) AS owner, regexp_extract(k, ':([^(]*)', 1) AS name, regexp_extract(k, ':[^(]*\\((.*)\\)', 1) AS args FROM k)
  SELECT k AS method_key, owner || ':' || CASE WHEN name = '<init>' THEN regexp_extract(owner, '([^$]*)$', 1) ELSE name END || '(' || CASE WHEN trim(args) = '' THEN '' ELSE array_to_string(list_transform(string_split(args, ','), lambda a: regexp_extract(string_split(trim(a), ' ')[1], '([^.]*)$', 1)), ',') END || ')' AS standard FROM p""")
def signature_standard(spark, sf):
    m = load(spark, sf, "methods", "method_key").where("contains(method_key, ':')").distinct()
    return m.select("method_key", text.standard_signature(F.col("method_key")).alias("standard"))


_SAN = "regexp_replace(regexp_replace(regexp_replace(method_key, '[:<>]', '-', 'g'), '\\?', '+', 'g'), '[\\\\/*\"|]', '_', 'g')"


@query(f"SELECT DISTINCT method_key, substr({_SAN}, 1, 200) AS sanitized, CASE WHEN length(substr({_SAN}, 1, 200)) > 80 THEN substr({_SAN}, 1, 60) || '_' || substr(sha1(method_key), 1, 12) ELSE substr({_SAN}, 1, 200) END || '.json' AS short_name FROM methods WHERE method_key IS NOT NULL")
def file_names(spark, sf):
    m = load(spark, sf, "methods", "method_key").where("method_key is not null").distinct()
    return m.select("method_key", text.sanitize_filename(F.col("method_key")).alias("sanitized"), text.short_graph_filename(F.col("method_key")).alias("short_name"))


@query("SELECT DISTINCT file_name, substr(regexp_replace(regexp_replace(file_name, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) || '_' || substr(sha256(file_name), 1, 12) AS slug FROM compile_result WHERE file_name IS NOT NULL")
def sha_slug(spark, sf):
    r = load(spark, sf, "compile_result", "file_name").where("file_name is not null").distinct()
    return r.select("file_name", text.sha_slug(F.col("file_name")).alias("slug"))


@query("SELECT result_id, strftime(recorded_at AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') AS stamp FROM compile_result WHERE recorded_at IS NOT NULL")
def run_id_format(spark, sf):
    return load(spark, sf, "compile_result", "result_id", "recorded_at").where("recorded_at is not null").select("result_id", F.date_format("recorded_at", "yyyyMMdd_HHmmss").alias("stamp"))


@query("SELECT header_id, coalesce(array_to_string(regexp_extract_all(raw_translated_code, '#\\s*include\\s*[<\"]([^>\"]+)[>\"]', 1), ';'), '') AS includes, CASE WHEN regexp_extract(raw_translated_code, '(?s)```[A-Za-z+]*\\s*\\n(.*?)```', 1) <> '' THEN trim(regexp_extract(raw_translated_code, '(?s)```[A-Za-z+]*\\s*\\n(.*?)```', 1)) ELSE trim(raw_translated_code) END AS code FROM headers WHERE raw_translated_code IS NOT NULL")
def fenced_code(spark, sf):
    h = load(spark, sf, "headers", "header_id", "raw_translated_code").where("raw_translated_code is not null")
    return h.select("header_id", F.array_join(text.includes(F.col("raw_translated_code")), ";").alias("includes"), text.fenced_code(F.col("raw_translated_code")).alias("code"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return load(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT method_id, json_valid(raw_translated_code) AS is_json, CASE WHEN json_valid(raw_translated_code) THEN json_extract_string(raw_translated_code, '$.java_signature') END AS java_signature FROM methods WHERE raw_translated_code IS NOT NULL")
def reply_json(spark, sf):
    """Replies that are JSON, permissively read."""
    m = load(spark, sf, "methods", "method_id", "raw_translated_code").where("raw_translated_code is not null")
    ok = F.try_parse_json("raw_translated_code").isNotNull()
    return m.select("method_id", ok.alias("is_json"), F.when(ok, F.get_json_object("raw_translated_code", "$.java_signature")).alias("java_signature"))


@query("""WITH m AS (SELECT method_id, project, run_id, header_key, method_key, mapping_status, regexp_extract(method_key, '^([^:]*)', 1) = header_key AS owned, mapping_status IN ('needs_cpp_body', 'needs_header_body') AS concrete, regexp_extract(method_key, ':(.*)$', 1) AS target FROM methods WHERE method_key IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY project, run_id, target ORDER BY owned DESC, concrete DESC, method_id) AS rn FROM m WHERE mapping_status IS NOT NULL)
  SELECT method_id, CASE WHEN rn = 1 THEN mapping_status ELSE 'deleted_or_merged' END AS final_status FROM w""")
def duplicate_target_winner(spark, sf):
    """Of methods with one target the owner's concrete one wins; the others are merged into it."""
    m = load(spark, sf, "methods", "method_id", *RUN, "header_key", "method_key", "mapping_status").where("method_key is not null and mapping_status is not null")
    m = m.withColumn("target", F.regexp_extract("method_key", r":(.*)$", 1))
    owned = (F.regexp_extract("method_key", r"^([^:]*)", 1) == F.col("header_key")).cast("int")
    concrete = F.col("mapping_status").isin("needs_cpp_body", "needs_header_body").cast("int")
    top = m.groupBy(*RUN, "target").agg(F.max_by("method_id", F.struct(owned, concrete, -F.col("method_id"))).alias("winner"))
    j = m.join(top, [*RUN, "target"])
    return j.select("method_id", F.when(F.col("method_id") == F.col("winner"), F.col("mapping_status")).otherwise("deleted_or_merged").alias("final_status"))


@query("""WITH p AS (SELECT method_id, code, regexp_extract(method_key, ':([^(]*)', 1) AS needle FROM methods WHERE code IS NOT NULL AND method_key IS NOT NULL)
  SELECT method_id, n, CASE WHEN n = 1 THEN 'applied' ELSE 'rejected' END AS outcome, CASE WHEN n = 1 THEN replace(code, needle, needle || '_') ELSE code END AS patched FROM (SELECT *, CAST((length(code) - length(replace(code, needle, ''))) / length(needle) AS BIGINT) AS n FROM p WHERE needle <> '') x""")
def unique_patch(spark, sf):
    """A replacement is applied only where its text occurs once."""
    m = load(spark, sf, "methods", "method_id", "code", "method_key").where("code is not null and method_key is not null").withColumn("needle", F.regexp_extract("method_key", r":([^(]*)", 1)).where("needle <> ''")
    n = ((F.length("code") - F.length(F.replace("code", "needle", F.lit("")))) / F.length("needle")).cast("long")
    return m.withColumn("n", n).select("method_id", "n", F.when(F.col("n") == 1, "applied").otherwise("rejected").alias("outcome"), F.when(F.col("n") == 1, F.replace("code", "needle", F.concat("needle", F.lit("_")))).otherwise(F.col("code")).alias("patched"))


@query("SELECT project, run_id, string_agg(DISTINCT inc, ';' ORDER BY inc) AS includes, count(DISTINCT header_key) AS n_headers FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) x WHERE inc IS NOT NULL GROUP BY ALL")
def include_lists(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies").select(*RUN, "header_key", F.explode("include_dependencies").alias("inc")).where("inc is not null")
    return h.groupBy(*RUN).agg(F.array_join(F.sort_array(F.collect_set("inc")), ";").alias("includes"), F.countDistinct("header_key").alias("n_headers"))


@query("SELECT header_id, cardinality(external_header_files) AS n_files, array_to_string(list_sort(map_keys(external_header_files)), ';') AS names FROM headers WHERE external_header_files IS NOT NULL")
def external_files(spark, sf):
    h = load(spark, sf, "headers", "header_id", "external_header_files").where("external_header_files is not null")
    return h.select("header_id", F.size("external_header_files").cast("long").alias("n_files"), F.array_join(F.sort_array(F.map_keys("external_header_files")), ";").alias("names"))


def _ir(key: str) -> list[str]:
    return [text.java_type_ir(p) for p in text.java_parameters(key)]


def _kinds(c: str) -> str:
    """Parameter types by kind, in SQL: generic names first, then plain ones, then arrays."""
    c = f"regexp_replace(regexp_replace({c}, '\\s+', '', 'g'), '(?:[a-z_]\\w*\\.)+', '', 'g')"
    for kind, names in (("sequence", "List|ArrayList|LinkedList|Collection|Iterable"), ("set", "Set|HashSet"), ("map", "Map|HashMap|LinkedHashMap"), ("optional", "Optional"), ("future", "CompletableFuture|Future")):
        c = f"regexp_replace(regexp_replace({c}, '\\b(?:{names})<', '{kind}(', 'g'), '\\b(?:{names})\\b', '{kind}', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '\\b(?:String|CharSequence)\\b', 'string', 'g'), '\\b(?:Date|Instant|LocalDate|LocalDateTime)\\b', 'date', 'g')"
    c = f"replace(regexp_replace(regexp_replace({c}, '\\b[A-Z][A-Za-z0-9_$]*<', 'object(', 'g'), '\\b[A-Z][A-Za-z0-9_$]*', 'object', 'g'), '>', ')')"
    for _ in range(2):
        c = f"regexp_replace({c}, '(\\w+(?:\\([^()]*\\))?)(?:\\[\\]|\\.\\.\\.)', 'array(\\1)', 'g')"
    return c


@query(f"SELECT method_id, {_kinds(chr(39).join(['regexp_extract(method_key, ', '\\((.*)\\)', ', 1)']))} AS ir FROM methods WHERE method_key IS NOT NULL")
def parameter_types(spark, sf):
    """Parameter types in one notation for both languages."""
    ir = text.batch(_ir, T.ArrayType(T.StringType()))
    return load(spark, sf, "methods", "method_id", "method_key").where("method_key is not null").select("method_id", F.array_join(ir(F.col("method_key")), ",").alias("ir"))


@query("SELECT method_id, regexp_replace(code, '(\"(?:\\\\.|[^\"\\\\\\n])*\"|''(?:\\\\.|[^''\\\\\\n])*'')|//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*(?:\\*+/|$)', '\\1', 'g') AS code FROM methods WHERE code IS NOT NULL")
def code_without_comments(spark, sf):
    strip = text.batch(text.strip_comments)
    return load(spark, sf, "methods", "method_id", "code").where("code is not null").select("method_id", strip(F.col("code")).alias("code"))


@query()
def normalized_signatures(spark, sf):
    norm = text.batch(text.normalize_signature)
    return load(spark, sf, "methods", "method_id", "method_key").where("method_key is not null").select("method_id", norm(F.col("method_key")).alias("signature"))


@query()
def json_objects(spark, sf):
    """The first object of each reply that parses, in canonical form; null where a reply holds none."""

    def part(s: str) -> str | None:
        found = text.json_part(s)
        try:
            return text.canonical_json(found) if found else None
        except ValueError:
            return None

    first = text.batch(part)
    return load(spark, sf, "methods", "method_id", "raw_translated_code").where("contains(raw_translated_code, '{')").select("method_id", first(F.col("raw_translated_code")).alias("object"))
