"""Rates, pivots, lookups and texts of reports, each beside the same question in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import declarations, predicates, rules, text
from ..operators import diagnostics, mapping, metrics
from ..sources import files
from ..tables import load, shared_dir
from . import class_sql
from .core_queries import RUN, SQL, query

_OK = "coalesce(success, false)"


def _results(spark, sf, *cols):
    return load(spark, sf, "compile_result", *cols, "success").withColumn("ok", metrics.as_flag(F.col("success"), False))


# ------------------------------------------------------------------ summaries written as CSV and read with derived columns
def _csv(spark, df, schema):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    files.write_csv(df, path)
    return files.csv(spark, path, schema)


@query(f"SELECT project, ai, count(*) AS total, count(*) FILTER ({_OK}) AS succeeded, round(100.0 * count(*) FILTER ({_OK}) / count(*), 2) AS success_rate, CASE WHEN ai LIKE '%-%' THEN split_part(ai, '-', 1) ELSE ai END AS family FROM compile_result WHERE kind = 'cpp' AND project IS NOT NULL AND ai IS NOT NULL GROUP BY project, ai")
def file_summary_csv(spark, sf):
    """The file summary as CSV; the rate and the model's family are derived when it is read."""
    r = _results(spark, sf, "project", "ai", "kind").where("kind = 'cpp' and project is not null and ai is not null")
    x = _csv(spark, r.groupBy("project", "ai").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("succeeded")), "project string, ai string, total long, succeeded long")
    return x.withColumns({"success_rate": metrics.percent(F.col("succeeded"), F.col("total")), "family": F.split_part("ai", F.lit("-"), F.lit(1))})


@query("SELECT project, ai, count(*) AS total, count(*) FILTER (mapping_status = 'already_implemented') AS succeeded, round(100.0 * count(*) FILTER (mapping_status = 'already_implemented') / count(*), 2) AS success_rate FROM methods WHERE project IS NOT NULL AND ai IS NOT NULL GROUP BY project, ai")
def method_summary_csv(spark, sf):
    m = load(spark, sf, "methods", "project", "ai", "mapping_status").where("project is not null and ai is not null")
    x = _csv(spark, m.groupBy("project", "ai").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("mapping_status") == "already_implemented").alias("succeeded")), "project string, ai string, total long, succeeded long")
    return x.withColumn("success_rate", metrics.percent(F.col("succeeded"), F.col("total")))


@query("SELECT project, run_id, file_name, count(*) AS n_results, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds, round(100.0 * count(*) FILTER (" + _OK + ") / count(*), 2) AS success_rate FROM compile_result WHERE project IS NOT NULL AND run_id IS NOT NULL AND file_name IS NOT NULL GROUP BY project, run_id, file_name")
def file_details_csv(spark, sf):
    """One row a file; lists are joined by semicolons, the rate is derived when it is read."""
    r = _results(spark, sf, *RUN, "file_name", "kind").where("project is not null and run_id is not null and file_name is not null")
    d = r.groupBy(*RUN, "file_name").agg(F.count(F.lit(1)).alias("n_results"), F.count_if("ok").alias("n_ok"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    x = _csv(spark, d, "project string, run_id string, file_name string, n_results long, n_ok long, kinds string")
    return x.select(*RUN, "file_name", "n_results", "kinds", metrics.percent(F.col("n_ok"), F.col("n_results")).alias("success_rate"))


@query(SQL["error_class_counts"])
def error_summary_csv(spark, sf):
    from .core_queries import error_class_counts

    return _csv(spark, error_class_counts(spark, sf), "project string, error_type string, n long")


# ------------------------------------------------------------------ pivots and averages
@query(f"WITH p AS (SELECT ai, project, count(*) FILTER ({_OK}) / count(*)::DOUBLE AS rate, count(*) AS n, count(*) FILTER ({_OK}) AS s FROM compile_result WHERE project IS NOT NULL AND ai IS NOT NULL GROUP BY ai, project), t AS (SELECT ai, count(*) AS n_calls, sum(ceil(length(coalesce(log_output, '')) / 4.0)) AS tokens FROM compile_result GROUP BY ai), l AS (SELECT ai, count(*) FILTER (linked) AS n_linked FROM (SELECT ai, project, run_id, coalesce(bool_and({_OK}) FILTER (kind = 'cpp'), true) AS linked FROM compile_result WHERE ai IS NOT NULL GROUP BY ALL) y GROUP BY ai) SELECT p.ai, round(sum(s) / sum(n), 6) AS micro, round(avg(rate), 6) AS macro, count(*) AS n_projects, CAST(any_value(t.tokens) AS BIGINT) AS tokens, any_value(l.n_linked) AS n_linked FROM p JOIN t USING (ai) JOIN l USING (ai) GROUP BY p.ai")
def batch_summary(spark, sf):
    """Micro and macro averages, linked runs and tokens of each model."""
    r = _results(spark, sf, "ai", *RUN, "kind", "log_output").where("ai is not null")
    p = r.where("project is not null").groupBy("ai", "project").agg(F.count_if("ok").alias("s"), F.count(F.lit(1)).alias("n"))
    p = p.groupBy("ai").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"), F.count(F.lit(1)).alias("n_projects"))
    t = r.groupBy("ai").agg(F.sum(F.ceil(F.length(F.coalesce("log_output", F.lit(""))) / 4.0)).alias("tokens"))
    linked = F.coalesce(F.bool_and(F.when(F.col("kind") == "cpp", F.col("ok"))), F.lit(True))
    n = r.groupBy("ai", *RUN).agg(linked.alias("linked")).groupBy("ai").agg(F.count_if("linked").alias("n_linked"))
    return p.join(t, "ai").join(n, "ai")


@query("""WITH h AS (SELECT ai, project, run_id, count(*) AS total, count(*) FILTER (latest_compile_status = 'success') AS s FROM headers WHERE ai IS NOT NULL GROUP BY ALL), r AS (SELECT project, run_id, max(round) AS rounds FROM compile_feedback GROUP BY ALL)
  SELECT h.ai, round(sum(s) / nullif(sum(total), 0)::DOUBLE, 6) AS micro, round(avg(CASE WHEN total > 0 THEN s / total::DOUBLE END), 6) AS macro, count(*) FILTER (s = total) AS n_converged, count(*) FILTER (r.rounds >= 3) AS n_at_limit, count(*) AS n_runs FROM h LEFT JOIN r USING (project, run_id) GROUP BY h.ai""")
def strict_aggregate(spark, sf, limit: int = 3):
    """Micro and macro averages over runs, how many converged and how many came to the last round."""
    h = load(spark, sf, "headers", "ai", *RUN, "latest_compile_status").where("ai is not null").groupBy("ai", *RUN).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("latest_compile_status") == "success").alias("s"))
    r = load(spark, sf, "compile_feedback", *RUN, "round").groupBy(*RUN).agg(F.max("round").alias("rounds"))
    return h.join(r, RUN, "left").groupBy("ai").agg(F.round(F.try_divide(F.sum("s"), F.sum("total")), 6).alias("micro"), F.round(F.avg(F.when(F.col("total") > 0, F.col("s") / F.col("total"))), 6).alias("macro"), F.count_if(F.col("s") == F.col("total")).alias("n_converged"), F.count_if(F.col("rounds") >= limit).alias("n_at_limit"), F.count(F.lit(1)).alias("n_runs"))


@query("""WITH b AS (SELECT project, round, count(*) FILTER (coalesce(success, false)) AS s FROM compile_feedback WHERE project IS NOT NULL AND round BETWEEN 1 AND 4 GROUP BY ALL), m AS (SELECT project, max(s) AS best FROM b GROUP BY ALL)
  SELECT b.project, any_value(m.best) AS best, string_agg(CASE WHEN s = best THEN round::VARCHAR END, ';' ORDER BY round) AS ties, """ + ", ".join(f"max(CASE WHEN round = {k} THEN s END) AS round_{k}" for k in (1, 2, 3, 4)) + " FROM b JOIN m USING (project) GROUP BY b.project")
def best_rounds(spark, sf):
    """The best round of each project, all that tie with it, and every round's value as a column."""
    b = load(spark, sf, "compile_feedback", "project", "round", "success").where("project is not null and round between 1 and 4").groupBy("project", "round").agg(F.count_if(metrics.as_flag(F.col("success"), False)).alias("s"))
    best = metrics.best_with_ties(b, ["project"], "round", "s").select("project", F.col("best_score").alias("best"), "ties")
    return best.join(metrics.fixed_pivot(b, ["project"], "round", [1, 2, 3, 4], F.col("s"), "round"), "project")


@query(f"SELECT project, run_id, CASE WHEN count(*) FILTER (kind = 'cpp') = 0 THEN 'N/A' ELSE printf('%.2f', 100.0 * count(*) FILTER (kind = 'cpp' AND {_OK}) / count(*) FILTER (kind = 'cpp')) END AS unit_rate FROM compile_result GROUP BY project, run_id")
def unit_rates(spark, sf):
    """The rate of implementation files as text; not available where a run has none."""
    r = _results(spark, sf, *RUN, "kind")
    n, s = F.count_if(F.col("kind") == "cpp"), F.count_if((F.col("kind") == "cpp") & F.col("ok"))
    return r.groupBy(*RUN).agg(predicates.number(F.try_divide(100.0 * s, n), "%.2f", "N/A").alias("unit_rate"))


@query(f"WITH p AS (SELECT project, kind, count(*) FILTER ({_OK}) / count(*)::DOUBLE AS rate FROM compile_result WHERE project IS NOT NULL GROUP BY ALL) SELECT project, round(max(CASE WHEN kind = 'cpp' THEN rate END), 6) AS cpp, round(max(CASE WHEN kind = 'header' THEN rate END), 6) AS header, round(avg(rate), 6) AS present_average FROM p GROUP BY project")
def present_average(spark, sf):
    """Each project's rate by kind and the average of those that are present."""
    p = _results(spark, sf, "project", "kind").where("project is not null").groupBy("project", "kind").agg((F.count_if("ok") / F.count(F.lit(1))).alias("rate"))
    w = p.groupBy("project").agg(*[F.round(F.max(F.when(F.col("kind") == k, F.col("rate"))), 6).alias(k) for k in ("cpp", "header")], F.collect_list("rate").alias("rates"))  # as many as there are kinds
    return w.select("project", "cpp", "header", F.round(F.aggregate("rates", F.lit(0.0), lambda a, x: a + x) / F.size("rates"), 6).alias("present_average"))


_TYPES = [t.lower().replace(" ", "_") for t in rules.ERROR_TYPES]


@query("WITH m AS (" + SQL["error_class_pivot"] + ") SELECT error_type, ai, n FROM (UNPIVOT (SELECT ai, " + ", ".join(f"n_{t} AS {t}" for t in _TYPES) + " FROM m) ON " + ", ".join(_TYPES) + " INTO NAME error_type VALUE n)")
def error_matrix(spark, sf):
    """The pivot of classes by model turned back to one row a cell."""
    from .core_queries import error_class_pivot

    p = error_class_pivot(spark, sf).select("ai", *[F.col(f"n_{t}").alias(t) for t in _TYPES])
    return metrics.unpivot(p, ["ai"], _TYPES, "error_type", "n")


@query(f"WITH r AS (SELECT project, file_name, stage, avg(CAST({_OK} AS INTEGER)) AS rate FROM compile_result WHERE project IS NOT NULL AND file_name IS NOT NULL GROUP BY ALL) SELECT project, file_name, round(coalesce(max(CASE WHEN stage = 'pre' THEN rate END), 0), 6) AS pre, round(coalesce(max(CASE WHEN stage = 'post' THEN rate END), 0), 6) AS post FROM r GROUP BY project, file_name")
def stage_heatmap(spark, sf):
    """Mean rates of each file by stage; a missing cell is zero."""
    r = _results(spark, sf, "project", "file_name", "stage").where("project is not null and file_name is not null")
    return r.groupBy("project", "file_name").pivot("stage", ["pre", "post"]).agg(F.avg(F.col("ok").cast("int"))).na.fill(0.0).select("project", "file_name", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"))


@query("WITH c AS (SELECT project, ai, error_type, count(*) AS n FROM (" + SQL["error_details"] + ") k GROUP BY ALL), m AS (SELECT error_type, avg(n) AS mean FROM c GROUP BY error_type) SELECT error_type, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, error_type) AS position FROM m")
def classes_by_mean(spark, sf):
    """Classes in the order of their mean number a project and model."""
    from .core_queries import classified

    c = classified(spark, sf).groupBy("project", "ai", "error_type").agg(F.count(F.lit(1)).alias("n")).groupBy("error_type").agg(F.avg("n").alias("mean"))
    return c.select("error_type", F.round("mean", 6).alias("mean"), F.row_number().over(Window.orderBy(F.desc("mean"), "error_type")).cast("long").alias("position"))  # over the few classes


# ------------------------------------------------------------------ lookups
@query("""WITH l AS (SELECT project, run_id, result_id, unnest(string_split(log_output, chr(10))) AS line FROM compile_result), e AS (SELECT DISTINCT project, run_id, result_id, regexp_extract(line, '^\\s*(?:[^\\s:/]*/)*([^\\s:/]+)\\.(?:h|cpp):(\\d+):\\d+: (?:fatal )?error:', 1) AS stem, TRY_CAST(regexp_extract(line, '^\\s*(?:[^\\s:/]*/)*([^\\s:/]+)\\.(?:h|cpp):(\\d+):\\d+: (?:fatal )?error:', 2) AS BIGINT) AS no FROM l),
  s AS (SELECT project, run_id, replace(header_key, '$', '_') AS stem, arg_min(raw_translated_code, header_id) AS code FROM headers WHERE raw_translated_code IS NOT NULL AND header_key IS NOT NULL GROUP BY ALL)
  SELECT e.result_id, e.stem, e.no AS line_no, string_split(s.code, chr(10))[e.no] AS line FROM e JOIN s USING (project, run_id, stem) WHERE e.no BETWEEN 1 AND len(string_split(s.code, chr(10)))""")
def error_source_lines(spark, sf):
    """The line of the translation that each error points at."""
    lines = load(spark, sf, "compile_result", *RUN, "result_id", "log_output").select(*RUN, "result_id", F.explode(F.split("log_output", "\n")).alias("line"))
    at = lambda k: F.regexp_extract("line", r"^\s*(?:[^\s:/]*/)*([^\s:/]+)\.(?:h|cpp):(\d+):\d+: (?:fatal )?error:", k)
    e = lines.select(*RUN, "result_id", at(1).alias("stem"), F.expr("try_cast(regexp_extract(line, '^\\\\s*(?:[^\\\\s:/]*/)*([^\\\\s:/]+)\\\\.(?:h|cpp):(\\\\d+):\\\\d+: (?:fatal )?error:', 2) as long)").alias("no")).where("stem <> '' and no >= 1").distinct()
    h = load(spark, sf, "headers", *RUN, "header_key", "header_id", "raw_translated_code").where("raw_translated_code is not null and header_key is not null")
    s = h.groupBy(*RUN, F.translate("header_key", "$", "_").alias("stem")).agg(F.min_by("raw_translated_code", "header_id").alias("code"))
    j = e.join(s, [*RUN, "stem"])
    return j.select("result_id", "stem", F.col("no").alias("line_no"), F.get(F.split("code", "\n"), (F.col("no") - 1).cast("int")).alias("line")).where("line is not null")


@query("""WITH h AS (SELECT DISTINCT project, run_id, header_key, translated_class_name FROM headers WHERE header_key IS NOT NULL), a AS (SELECT project, run_id, header_key, replace(header_key, '$', '_') || '.cpp' AS file_name, 1 AS pos FROM h UNION ALL SELECT project, run_id, header_key, translated_class_name || '.cpp', 2 FROM h UNION ALL SELECT project, run_id, header_key, replace(header_key, '$', '_') || '.h', 3 FROM h)
  SELECT a.project, a.run_id, a.header_key, arg_min(a.file_name, a.pos) AS artifact FROM a JOIN (SELECT DISTINCT project, run_id, file_name FROM compile_result) r USING (project, run_id, file_name) GROUP BY ALL""")
def artifact_alias(spark, sf):
    """The first of a header's possible file names that was compiled."""
    h = load(spark, sf, "headers", *RUN, "header_key", "translated_class_name").where("header_key is not null").distinct()
    out = F.translate("header_key", "$", "_")
    names = F.array(F.concat(out, F.lit(".cpp")), F.concat("translated_class_name", F.lit(".cpp")), F.concat(out, F.lit(".h")))
    a = h.select(*RUN, "header_key", F.posexplode(names).alias("pos", "file_name")).where("file_name is not null")
    r = load(spark, sf, "compile_result", *RUN, "file_name").distinct()
    return a.join(r, [*RUN, "file_name"]).groupBy(*RUN, "header_key").agg(F.min_by("file_name", "pos").alias("artifact"))


@query("""WITH f AS (SELECT DISTINCT project, run_id, file_name, regexp_replace(file_name, '\\.(h|cpp)$', '') AS stem FROM compile_result WHERE file_name IS NOT NULL), w AS (SELECT project, run_id, result_id, unnest(regexp_extract_all(log_output, '[A-Za-z_][A-Za-z0-9_]*')) AS stem FROM compile_result WHERE NOT coalesce(success, false)),
  n AS (SELECT w.result_id, f.file_name, count(*) AS n FROM w JOIN f USING (project, run_id, stem) GROUP BY ALL)
  SELECT result_id, file_name, n FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY n DESC, file_name) AS rn FROM n) x WHERE rn = 1""")
def repair_target(spark, sf):
    """The file of the run that a failed log names most often; ties go to the first name."""
    r = load(spark, sf, "compile_result", *RUN, "result_id", "file_name", "success", "log_output")
    f = r.where("file_name is not null").select(*RUN, "file_name", F.regexp_replace("file_name", r"\.(h|cpp)$", "").alias("stem")).distinct()
    w = r.where(~F.coalesce("success", F.lit(False))).select(*RUN, "result_id", F.explode(F.regexp_extract_all("log_output", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("stem"))
    w = w.groupBy(*RUN, "result_id", "stem").agg(F.count(F.lit(1)).alias("k"))
    n = w.join(f, [*RUN, "stem"]).groupBy("result_id", "file_name").agg(F.sum("k").alias("n"))
    best = n.groupBy("result_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "file_name")).alias("b"))
    return best.select("result_id", "b.file_name", (-F.col("b.m")).alias("n"))


@query("""WITH m AS (SELECT DISTINCT project, run_id, header_key FROM methods WHERE header_key IS NOT NULL), h AS (SELECT DISTINCT project, run_id, header_key FROM headers WHERE header_key IS NOT NULL), f AS (SELECT DISTINCT project, run_id, header_key FROM compile_feedback WHERE header_key IS NOT NULL), k AS (SELECT * FROM m UNION SELECT * FROM h UNION SELECT * FROM f)
  SELECT k.project, k.run_id, k.header_key, h.header_key IS NOT NULL AS has_header, m.header_key IS NOT NULL AS has_methods, f.header_key IS NOT NULL AS has_feedback FROM k LEFT JOIN h USING (project, run_id, header_key) LEFT JOIN m USING (project, run_id, header_key) LEFT JOIN f USING (project, run_id, header_key)""")
def unmatched_units(spark, sf):
    """In which stages each header was seen."""
    keys = [*RUN, "header_key"]
    seen = lambda t, n: load(spark, sf, t, *keys).where("header_key is not null").select(*keys, *[F.lit(n == x).alias(x) for x in ("has_header", "has_methods", "has_feedback")])
    return seen("headers", "has_header").union(seen("methods", "has_methods")).union(seen("compile_feedback", "has_feedback")).groupBy(*keys).agg(*[F.bool_or(x).alias(x) for x in ("has_header", "has_methods", "has_feedback")])


@query("SELECT feedback_id, project, run_id, header_key, round FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, header_key, round ORDER BY recorded_at DESC NULLS LAST, feedback_id DESC) AS rn FROM compile_feedback) x WHERE rn = 1")
def reports_by_round(spark, sf):
    """Of reports of the same round the later one stays."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "recorded_at")
    return f.groupBy(*RUN, "header_key", "round").agg(F.max_by("feedback_id", F.struct(F.col("recorded_at").isNotNull(), "recorded_at", "feedback_id")).alias("feedback_id"))


# ------------------------------------------------------------------ texts
@query("SELECT method_id, regexp_replace(method_key, '(?:[A-Za-z_]\\w*\\.)+([A-Za-z_])', '\\1', 'g') AS without_packages, regexp_extract(regexp_extract(method_key, '^([^(]*)', 1), '([^:.]*)$', 1) AS bare_name FROM methods WHERE method_key IS NOT NULL")
def key_parts(spark, sf):
    m = load(spark, sf, "methods", "method_id", "method_key").where("method_key is not null")
    return m.select("method_id", text.strip_packages(F.col("method_key")).alias("without_packages"), text.method_name(F.col("method_key")).alias("bare_name"))


@query("SELECT header_id, array_to_string(list_filter(f, (x, i) -> list_position(f, x) = i), ';') AS forward FROM (SELECT header_id, regexp_extract_all(raw_translated_code, '(?:class|struct)\\s+(\\w+)\\s*;', 1) AS f FROM headers WHERE raw_translated_code IS NOT NULL) h".replace("(x, i) -> ", "lambda x, i: "))
def forward_declared(spark, sf):
    """Distinct forward declarations of each translation, in order."""
    h = load(spark, sf, "headers", "header_id", "raw_translated_code").where("raw_translated_code is not null")
    return h.select("header_id", F.array_join(text.forward_declarations(F.col("raw_translated_code")), ";").alias("forward"))


@query("SELECT DISTINCT file_path, lower(regexp_replace(replace(file_path, '\\', '/'), '^(?:\\./)+', '')) AS normal FROM (SELECT regexp_extract(line, '^\\s*([^\\s:][^:]*):\\d+:\\d+:', 1) AS file_path FROM (SELECT unnest(string_split(log_output, chr(10))) AS line FROM compile_result) l) p WHERE file_path <> ''")
def normal_paths(spark, sf):
    lines = load(spark, sf, "compile_result", "log_output").select(F.explode(F.split("log_output", "\n")).alias("line"))
    p = lines.select(F.regexp_extract("line", r"^\s*([^\s:][^:]*):\d+:\d+:", 1).alias("file_path")).where("file_path <> ''").distinct()
    return p.select("file_path", text.norm_path(F.col("file_path")).alias("normal"))


@query("WITH l AS (SELECT header_id, string_split(source_code, chr(10)) AS l FROM headers WHERE source_code IS NOT NULL), c AS (SELECT header_id, len(l) > 20 AS cut, array_to_string(l[1:20], chr(10)) AS head FROM l) SELECT header_id, CASE WHEN length(head) > 600 THEN rtrim(substr(head, 1, 600)) || chr(10) || '...[truncated]' WHEN cut THEN head || chr(10) || '...[truncated]' ELSE head END AS context FROM c")
def capped_context(spark, sf):
    """A source shortened for a prompt: lines first, then characters."""
    h = load(spark, sf, "headers", "header_id", "source_code").where("source_code is not null")
    return h.select("header_id", diagnostics.cap_context(F.col("source_code"), 20, 600).alias("context"))


@query("SELECT feedback_id, (row_number() OVER w > 4 AND sum(length(coalesce(array_to_string(diagnostic_blocks, ''), ''))) OVER w > 2000) AS dropped FROM compile_feedback WHERE round IS NOT NULL WINDOW w AS (PARTITION BY project, run_id, header_key ORDER BY round DESC, feedback_id DESC ROWS UNBOUNDED PRECEDING)")
def history_budget(spark, sf):
    """Which old turns a budget of characters drops."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "diagnostic_blocks").where("round is not null").withColumns({"turn": F.struct("round", "feedback_id"), "said": F.array_join("diagnostic_blocks", "")})
    return diagnostics.history_under_budget(f, [*RUN, "header_key"], "turn", "said", 2000, 4).select("feedback_id", "dropped")


@query(f"WITH l AS (SELECT result_id, unnest(string_split(log_output, chr(10))) AS line FROM compile_result), m AS (SELECT result_id, trim(regexp_replace(trim(regexp_extract(trim(replace(line, chr(13), '')), '(?:fatal\\s+)?error:\\s*(.+?)\\s*$', 1)), '\\s*\\[-[^\\]]+\\]\\s*$', '')) AS msg FROM l) SELECT result_id, {class_sql.classes('msg')} AS error_type, count(DISTINCT msg) AS n FROM m WHERE msg <> '' AND NOT contains(msg, 'too many errors emitted') GROUP BY ALL")
def raw_log_classes(spark, sf):
    """Classes of the messages of every log, whatever its result says."""
    m = load(spark, sf, "compile_result", "result_id", "log_output").select("result_id", F.explode(rules.error_lines(F.col("log_output"))).alias("msg"))
    return m.groupBy("result_id", rules.classify(F.col("msg")).alias("error_type")).agg(F.countDistinct("msg").alias("n"))


@query("SELECT project, run_id, header_key, count(*) AS n_reports, count(*) FILTER (NOT coalesce(success, false) AND coalesce(has_local_issues, false)) AS n_local, count(*) FILTER (NOT coalesce(success, false) AND NOT coalesce(has_local_issues, false) AND coalesce(blocked_by_dependency, false)) AS n_blocked, coalesce(bool_or(coalesce(success, false)), false) AS ever_ok FROM compile_feedback GROUP BY ALL")
def blocked_rollup(spark, sf):
    """Per header how often it failed by itself and how often only because of others."""
    f = load(spark, sf, "compile_feedback", *RUN, "header_key", "success", "has_local_issues", "blocked_by_dependency")
    ok, local, blocked = (F.coalesce(c, F.lit(False)) for c in ("success", "has_local_issues", "blocked_by_dependency"))
    return f.groupBy(*RUN, "header_key").agg(F.count(F.lit(1)).alias("n_reports"), F.count_if(~ok & local).alias("n_local"), F.count_if(~ok & ~local & blocked).alias("n_blocked"), F.bool_or(ok).alias("ever_ok"))


@query("SELECT header_id, NOT starts_with(replace(header_key, '$', '_') || '.cpp', '__') AND NOT regexp_matches(coalesce(raw_translated_code, ''), '\\bmain\\s*\\(') AS production FROM headers WHERE header_key IS NOT NULL")
def production_sources(spark, sf):
    """Translations that belong to the product: no helpers by name, no program of their own."""
    h = load(spark, sf, "headers", "header_id", "header_key", "raw_translated_code").where("header_key is not null")
    return h.select("header_id", predicates.production_source(F.concat(F.translate("header_key", "$", "_"), F.lit(".cpp")), F.coalesce("raw_translated_code", F.lit(""))).alias("production"))


# ------------------------------------------------------------------ mapping
_D = "trim(coalesce(raw_translated_code, ''))"


@query(f"SELECT method_id, CASE WHEN coalesce(mapping_status = 'deleted_or_merged', false) THEN 'deleted_or_merged' WHEN {_D} = '' THEN 'unmapped' WHEN NOT contains({_D}, '(') THEN 'invalid_cpp_definition' WHEN coalesce(mapping_status = 'pure_virtual', false) OR regexp_matches({_D}, '=\\s*0\\s*;?\\s*$') THEN 'pure_virtual' WHEN regexp_matches({_D}, '=\\s*(default|delete)\\s*;?\\s*$') THEN 'defaulted_or_deleted' WHEN contains({_D}, '{{') THEN 'already_implemented' WHEN coalesce(method_body_location = 'header', false) THEN 'needs_header_body' ELSE 'needs_cpp_body' END AS status FROM methods")
def item_statuses(spark, sf):
    """The status that each method's definition gives it."""
    m = load(spark, sf, "methods", "method_id", "raw_translated_code", "mapping_status", "method_body_location")
    return m.select("method_id", mapping.item_status(F.col("raw_translated_code"), F.col("method_body_location") == "header", F.col("mapping_status") == "deleted_or_merged", F.col("mapping_status") == "pure_virtual").alias("status"))


@query("""WITH e AS (SELECT DISTINCT project || '|' || run_id || '|' || method_key AS k FROM methods WHERE project IS NOT NULL AND method_key IS NOT NULL), m AS (SELECT project || '|' || run_id || '|' || regexp_replace(dst, '^\\([A-Z]*\\)', '') AS k, count(*) AS n FROM (SELECT DISTINCT project, run_id, src, dst FROM call_edge WHERE project IS NOT NULL AND dst IS NOT NULL) c GROUP BY 1)
  SELECT coalesce(e.k, m.k) AS key, CASE WHEN m.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unknown' ELSE 'duplicate' END AS violation FROM e FULL OUTER JOIN m ON e.k = m.k WHERE m.k IS NULL OR e.k IS NULL OR m.n > 1""")
def completeness_violations(spark, sf):
    """Methods that nothing names, names that no method has, and methods named more than once."""
    k = lambda c: F.concat_ws("|", "project", "run_id", c).alias("key")
    e = load(spark, sf, "methods", *RUN, "method_key").where("project is not null and method_key is not null").select(k("method_key"))
    m = load(spark, sf, "call_edge", *RUN, "src", "dst").where("project is not null and dst is not null").distinct().select(k(F.regexp_replace("dst", r"^\([A-Z]*\)", "")))
    return mapping.completeness_violations(e, m, "key")


@query(r"""SELECT method_id, array_to_string(list_filter([CASE WHEN regexp_matches(code, '\bstatic\b') AND NOT regexp_matches(raw_translated_code, '\bstatic\b') THEN 'static_lost' END, CASE WHEN contains(code, '...') AND NOT regexp_matches(raw_translated_code, '\.\.\.|vector|initializer_list') THEN 'varargs_lost' END,
  CASE WHEN regexp_matches(code, '\bvoid\s+\w+\s*\(') <> regexp_matches(raw_translated_code, '\bvoid\s+[\w:]+\s*\(') THEN 'void_mismatch' END], lambda v: v IS NOT NULL), ';') AS lost FROM methods WHERE code IS NOT NULL AND raw_translated_code IS NOT NULL""")
def semantic_losses(spark, sf):
    """What a translation lost of its method's signature."""
    m = load(spark, sf, "methods", "method_id", "code", "raw_translated_code").where("code is not null and raw_translated_code is not null")
    return m.select("method_id", F.array_join(mapping.semantic_warnings(F.col("code"), F.col("raw_translated_code")), ";").alias("lost"))


@query("""WITH t AS (SELECT project, run_id, header_key, arg_min(header_type, header_id) AS header_type FROM headers WHERE header_key IS NOT NULL GROUP BY ALL)
  SELECT m.method_id, coalesce(t.header_type, '') <> 'interface' AND NOT coalesce(m.skip_translation, false) AND NOT coalesce(m.mapping_status = 'deleted_or_merged', false) AND coalesce(trim(m.method_body_location), '') <> '' AND coalesce(trim(m.raw_translated_code), '') = '' AS pending FROM methods m LEFT JOIN t USING (project, run_id, header_key)""")
def translation_queue(spark, sf):
    """Methods that still wait for a translation: of no interface, not skipped or merged, with a place for their body."""
    t = load(spark, sf, "headers", *RUN, "header_key", "header_id", "header_type").where("header_key is not null").groupBy(*RUN, "header_key").agg(F.min_by("header_type", "header_id").alias("header_type"))
    m = load(spark, sf, "methods", "method_id", *RUN, "header_key", "skip_translation", "mapping_status", "method_body_location", "raw_translated_code").join(t, [*RUN, "header_key"], "left")
    return m.select("method_id", predicates.pending_method(F.col("header_type"), F.col("skip_translation"), F.col("mapping_status") == "deleted_or_merged", F.col("method_body_location"), predicates.filled(F.col("raw_translated_code"))).alias("pending"))


_BARE = "regexp_replace(raw_translated_code, '(\"(?:\\\\.|[^\"\\\\\\n])*\"|''(?:\\\\.|[^''\\\\\\n])*'')|//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*(?:\\*+/|$)', '\\1', 'g')"


@query(f"SELECT header_id, array_to_string(list_transform(regexp_extract_all({_BARE}, '(?m)^\\s*static\\s+(?:const\\s+)?[\\w:<>, *&]+?\\s+([A-Za-z_]\\w*)\\s*;', 1), lambda n: n), ';') AS statics FROM headers WHERE raw_translated_code IS NOT NULL AND NOT regexp_matches({_BARE}, 'static\\s+(constexpr|inline)')")
def static_declared(spark, sf):
    """Static data members of each translation that need a definition elsewhere."""
    names = text.batch(lambda c: ";".join(n for _, n in declarations.static_members(c)))
    h = load(spark, sf, "headers", "header_id", "raw_translated_code").where("raw_translated_code is not null")
    bare = text.batch(text.strip_comments)(F.col("raw_translated_code"))
    return h.where(~bare.rlike(r"static\s+(constexpr|inline)")).select("header_id", names(F.col("raw_translated_code")).alias("statics"))


@query("SELECT m.method_id, contains(coalesce(f.target, ''), regexp_extract(m.method_key, ':([^(]*)', 1) || '(') AS named FROM methods m LEFT JOIN (SELECT project, run_id, header_key, arg_min(raw_translated_code, header_id) FILTER (raw_translated_code IS NOT NULL) AS target FROM headers WHERE header_key IS NOT NULL GROUP BY ALL) f USING (project, run_id, header_key) WHERE m.method_key IS NOT NULL AND regexp_extract(m.method_key, ':([^(]*)', 1) <> ''")
def header_mentions(spark, sf):
    """Whether a header's translation names each of its methods."""
    from .graph_queries import first_targets

    m = load(spark, sf, "methods", "method_id", *RUN, "header_key", "method_key").where("method_key is not null").withColumn("name", F.regexp_extract("method_key", r":([^(]*)", 1)).where("name <> ''")
    return m.join(first_targets(spark, sf), [*RUN, "header_key"], "left").select("method_id", F.contains(F.coalesce("target", F.lit("")), F.concat("name", F.lit("("))).alias("named"))
