"""Further queries: diagnostics, mapping rules, fragments, usage, streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diagnostics, mapping, metrics, reports
from ..streaming import ingest
from ..tables import Stage, load
from . import core_queries as core
from .core_queries import RUN, query


@query()
def diagnostic_blocks(spark, sf):
    return diagnostics.extract_blocks(load(spark, sf, "compile_result", "result_id", "log_output"))


@query()
def block_scopes(spark, sf):
    """Whose file each block concerns: the header's own, the project's, or a foreign one."""
    r = load(spark, sf, "compile_result", "result_id", *RUN, "file_name", "log_output")
    blocks = Stage(spark, "blocks").put(diagnostics.extract_blocks(r).join(r.select("result_id", *RUN, "file_name"), "result_id"))
    # of a run's files each block gets those that it names
    last = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+)$", 1))
    named = blocks.select("result_id", "block_no", *RUN, F.explode(F.regexp_extract_all(F.lower("block"), F.lit(r"([\w$.-]+\.(?:hpp|cpp|cc|h))"), F.lit(1))).alias("base")).distinct()
    files = r.where("file_name is not null").select(*RUN, "file_name", last("file_name").alias("base")).distinct().withColumnRenamed("file_name", "owned")
    owned = named.join(files, [*RUN, "base"]).groupBy("result_id", "block_no").agg(F.collect_set("owned").alias("owned"))
    return diagnostics.scoped_blocks(blocks.join(owned, ["result_id", "block_no"], "left"))


_BARE = "array_to_string(list_filter(string_split(regexp_replace(log_output, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: NOT (contains(x, 'In file included from') AND NOT contains(x, 'error:'))), chr(10))"


@query(f"SELECT result_id, CASE WHEN length(log_output) <= 800 THEN log_output WHEN length({_BARE}) > 800 THEN substr({_BARE}, 1, 800) || chr(10) || '...[truncated]' ELSE {_BARE} END AS log FROM compile_result WHERE log_output IS NOT NULL")
def compact_logs(spark, sf):
    return load(spark, sf, "compile_result", "result_id", "log_output").where("log_output is not null").select("result_id", diagnostics.compact_log(F.col("log_output"), 800).alias("log"))


@query("SELECT feedback_id, len(diagnostic_blocks) AS n_blocks, array_to_string(list_slice(diagnostic_blocks, 1, 2), chr(10) || chr(10)) || CASE WHEN len(diagnostic_blocks) > 2 THEN chr(10) || '... ' || (len(diagnostic_blocks) - 2) || ' more' ELSE '' END AS summary FROM compile_feedback WHERE diagnostic_blocks IS NOT NULL")
def block_summaries(spark, sf):
    f = load(spark, sf, "compile_feedback", "feedback_id", "diagnostic_blocks").where("diagnostic_blocks is not null")
    return f.select("feedback_id", F.size("diagnostic_blocks").cast("long").alias("n_blocks"), diagnostics.summarize(F.col("diagnostic_blocks"), 2).alias("summary"))


@query("""WITH b AS (SELECT feedback_id, project, run_id, header_key, round, unnest(diagnostic_blocks) AS block FROM compile_feedback),
  h AS (SELECT DISTINCT project, run_id, header_key FROM headers WHERE NOT contains(header_key, '$')),
  t AS (SELECT DISTINCT b.feedback_id, b.project, b.run_id, b.header_key, x.name FROM b, LATERAL (SELECT unnest(regexp_extract_all(b.block, '''([A-Za-z_0-9]+)''', 1)) AS name) x WHERE b.block IS NOT NULL)
  SELECT t.feedback_id, t.header_key, t.name AS other FROM t JOIN h ON h.project = t.project AND h.run_id = t.run_id AND h.header_key = t.name WHERE t.name <> t.header_key""")
def cross_header_errors(spark, sf):
    """Diagnostics of a header that name another header of its run."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "diagnostic_blocks")
    b = f.select("feedback_id", *RUN, "header_key", F.explode("diagnostic_blocks").alias("block")).where("block is not null")
    t = b.select("feedback_id", *RUN, "header_key", F.explode(F.regexp_extract_all("block", F.lit(r"'([A-Za-z_0-9]+)'"), F.lit(1))).alias("name")).distinct()
    h = load(spark, sf, "headers", *RUN, F.col("header_key").alias("name")).where("not contains(name, '$')").distinct()
    return t.join(h, [*RUN, "name"]).where("name <> header_key").select("feedback_id", "header_key", F.col("name").alias("other"))


@query("""WITH i AS (SELECT DISTINCT project, run_id, header_key, regexp_replace(inc, '\\.(h|hpp)$', '') AS target FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) x WHERE inc IS NOT NULL),
  u AS (SELECT project, run_id, header_key, target, 0 AS tier FROM i UNION ALL SELECT a.project, a.run_id, a.header_key, b.target, 1 FROM i a JOIN i b ON a.project = b.project AND a.run_id = b.run_id AND b.header_key = a.target WHERE b.target <> a.header_key),
  d AS (SELECT project, run_id, header_key, target, min(tier) AS tier FROM u GROUP BY ALL)
  SELECT project, run_id, header_key, target, tier, rn FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY tier, target) AS rn FROM d) x WHERE rn <= 4""")
def related_headers(spark, sf):
    """Up to four related headers: own includes first, then includes of includes."""
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies")
    i = h.select(*RUN, "header_key", F.explode("include_dependencies").alias("inc")).where("inc is not null").select(*RUN, "header_key", F.regexp_replace("inc", r"\.(h|hpp)$", "").alias("target")).distinct()
    two = i.select(*RUN, "header_key", F.col("target").alias("mid")).join(i.select(*RUN, F.col("header_key").alias("mid"), "target"), [*RUN, "mid"]).where("target <> header_key").select(*RUN, "header_key", "target", F.lit(1).alias("tier"))
    d = i.withColumn("tier", F.lit(0)).union(two).groupBy(*RUN, "header_key", "target").agg(F.min("tier").alias("tier"))
    rn = F.row_number().over(Window.partitionBy(*RUN, "header_key").orderBy("tier", "target")).cast("long")
    return d.withColumn("rn", rn).where("rn <= 4")


@query("""WITH i AS (SELECT DISTINCT project, run_id, header_key, regexp_replace(inc, '\\.(h|hpp)$', '') AS target FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) x WHERE inc IS NOT NULL)
  SELECT project, run_id, target, string_agg(header_key, ';' ORDER BY header_key) AS includers FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, target ORDER BY header_key) AS rn FROM i) x WHERE rn <= 4 GROUP BY ALL""")
def includer_context(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies")
    i = h.select(*RUN, "header_key", F.explode("include_dependencies").alias("inc")).where("inc is not null").select(*RUN, "header_key", F.regexp_replace("inc", r"\.(h|hpp)$", "").alias("target")).distinct()
    rn = F.row_number().over(Window.partitionBy(*RUN, "target").orderBy("header_key"))
    return i.withColumn("rn", rn).where("rn <= 4").groupBy(*RUN, "target").agg(F.array_join(F.sort_array(F.collect_list("header_key")), ";").alias("includers"))


_LOCR = r"^\s*([^\s:][^:]*):(\d+):(\d+):"


@query("""WITH c AS (SELECT project, run_id, header_key, arg_min(source_code, header_id) AS source_code FROM headers WHERE source_code IS NOT NULL GROUP BY ALL)
  SELECT project, run_id, header_key, generate_subscripts(string_split(source_code, chr(10)), 1) AS line_no, unnest(string_split(source_code, chr(10))) AS line FROM c""")
def source_lines(spark, sf):
    """Every line of a source under its number, for lookups by (file, line)."""
    h = load(spark, sf, "headers", "header_id", *RUN, "header_key", "source_code").where("source_code is not null")
    c = h.groupBy(*RUN, "header_key").agg(F.min_by("source_code", "header_id").alias("source_code"))
    x = c.select(*RUN, "header_key", F.posexplode(F.split("source_code", "\n")).alias("pos", "line"))
    return x.select(*RUN, "header_key", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


_PAIRS = "SELECT 'headers' AS record_kind, header_id AS record_id, source_code AS s, coalesce(raw_translated_code, '') AS t FROM headers WHERE source_code IS NOT NULL UNION ALL SELECT 'methods', method_id, code, coalesce(raw_translated_code, '') FROM methods WHERE code IS NOT NULL"
_B = "(?:^|[^:])\\b"  # no colon before the word
# what each rule asks of a source and what fails it, as SQL of its own
_RULE_SQL = [
    ("declaration-kind", "regexp_matches(s, '\\b(?:class|interface|enum)\\s+')", "h AND kind <> '' AND NOT regexp_matches(t, CASE WHEN kind = 'enum' THEN '\\benum(?:\\s+class)?\\s+' ELSE '\\b(?:class|struct)\\s+' END || name || '\\b')"),
    ("interface-virtual-dispatch", "regexp_matches(s, '\\binterface\\s+')", "h AND (NOT contains(t, 'virtual') OR (regexp_matches(s, '\\([^;{}]*\\)\\s*;') AND NOT contains(t, '= 0') AND NOT contains(t, '=0')))"),
    ("inheritance", "regexp_matches(s, '\\b(?:extends|implements)\\b')", "h AND NOT regexp_matches(t, '\\b(?:class|struct)\\s+\\w+[^\\{;]*:\\s*(?:public\\s+)?\\w+')"),
    ("primitive-types", "regexp_matches(s, '\\b(?:boolean|byte|short|int|long|float|double|char)\\b')", "regexp_matches(t, '\\bboolean\\b')"),
    ("string", "regexp_matches(s, '\\bString\\b')", f"regexp_matches(t, '{_B}String\\b')"),
    ("arrays", "regexp_matches(s, '\\[\\s*\\]')", "regexp_matches(t, '\\b[A-Za-z_]\\w*(?:<[^;{}]+>)?\\s*\\[\\s*\\]')"),
    ("collections-generics", "regexp_matches(s, '\\b(?:List|ArrayList|Map|HashMap|Set|HashSet|Collection|Optional)\\s*<')", "regexp_matches(replace(t, 'std::', 'std__'), '\\b(?:List|ArrayList|Map|HashMap|Set|HashSet|Collection|Optional)\\s*<')"),
    ("nullability", "regexp_matches(s, '\\bnull\\b')", "regexp_matches(t, '\\bnull\\b')"),
    ("static-initialization", "regexp_matches(s, '\\bstatic\\b')", "h AND regexp_matches(s, '\\bstatic\\b[^;()]*;') AND NOT contains(t, 'static')"),
    ("exceptions", "regexp_matches(s, '\\b(?:throw|throws|Exception|Throwable)\\b')", "regexp_matches(t, '\\bthrows\\b')"),
    ("constructors-overloads", "regexp_matches(s, '\\b(?:public|protected|private)\\s+[A-Za-z_]\\w*\\s*\\(')", "h AND cname <> '' AND regexp_matches(s, '\\b' || cname || '\\s*\\(') AND NOT regexp_matches(t, '\\b' || cname || '\\s*\\(')"),
    ("override", "regexp_matches(s, '@Override|\\boverride\\b')", "h AND NOT contains(t, 'override')"),
    ("synchronization", "regexp_matches(s, '\\bsynchronized\\b|\\bAtomic[A-Za-z]+\\b')", "regexp_matches(t, '\\bsynchronized\\b') OR NOT regexp_matches(t, 'mutex|lock_guard|scoped_lock|unique_lock|atomic')"),
    ("threading", "regexp_matches(s, '\\b(?:Thread|ExecutorService|Future|CompletableFuture)\\b')", "regexp_matches(replace(t, 'std::', 'std__'), '\\b(?:Thread|ExecutorService|Future|CompletableFuture)\\b')"),
    ("java-standard-library", "regexp_matches(s, '\\bjava\\.[A-Za-z_]')", "regexp_matches(t, '\\bjava\\s*(?:::|\\.)')"),
]
_SEEN = f"WITH p AS ({_PAIRS}), x AS (SELECT *, record_kind = 'headers' AS h, regexp_extract(s, '\\b(class|interface|enum)\\s+([A-Za-z_]\\w*)', 1) AS kind, regexp_extract(s, '\\b(class|interface|enum)\\s+([A-Za-z_]\\w*)', 2) AS name, regexp_extract(s, '\\bclass\\s+([A-Za-z_]\\w*)', 1) AS cname FROM p)"
_listed = lambda parts: "array_to_string(list_filter([" + ", ".join(parts) + "], lambda v: v IS NOT NULL), ';')"


def code_pairs(spark, sf):
    """Every source with its translation; a missing one counts as empty."""
    h = load(spark, sf, "headers", F.lit("headers").alias("record_kind"), F.col("header_id").alias("record_id"), F.col("source_code").alias("s"), F.coalesce("raw_translated_code", F.lit("")).alias("t"))
    m = load(spark, sf, "methods", F.lit("methods").alias("record_kind"), F.col("method_id").alias("record_id"), F.col("code").alias("s"), F.coalesce("raw_translated_code", F.lit("")).alias("t"))
    return h.union(m).where("s is not null")


@query(f"{_SEEN} SELECT record_kind, record_id, {_listed([f"CASE WHEN {a} THEN '{n}' END" for n, a, _ in _RULE_SQL])} AS features FROM x")
def feature_rules(spark, sf):
    """The feature rules that apply to each source."""
    return code_pairs(spark, sf).select("record_kind", "record_id", F.array_join(mapping.applicable_features(F.col("s")), ";").alias("features"))


@query(f"{_SEEN} SELECT record_kind, record_id, {_listed([f"CASE WHEN ({a}) AND ({b}) THEN '{n}' END" for n, a, b in _RULE_SQL])} AS broken FROM x")
def broken_features(spark, sf):
    """The applying rules that each translation fails."""
    return code_pairs(spark, sf).select("record_kind", "record_id", F.array_join(mapping.broken_features(F.col("s"), F.col("t"), F.col("record_kind") == "headers"), ";").alias("broken"))


@query("SELECT ai, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS total, CAST(sum(loc) AS BIGINT) AS total_loc, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS rate, round(coalesce(sum(CASE WHEN ok THEN loc ELSE 0 END) / nullif(sum(loc), 0)::DOUBLE, 0), 6) AS loc_rate FROM (SELECT ai, 'header' AS kind, coalesce(latest_compile_status = 'success', false) AS ok, len(string_split(coalesce(source_code, ''), chr(10))) AS loc FROM headers UNION ALL SELECT ai, 'method', coalesce(mapping_status = 'already_implemented', false), len(string_split(coalesce(code, ''), chr(10))) FROM methods) f GROUP BY GROUPING SETS ((ai, kind), (ai))")
def fragment_rates(spark, sf):
    """Count and LoC rates of headers and methods, and of both."""
    loc = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n")).cast("long").alias("loc")
    h = load(spark, sf, "headers", "ai", "latest_compile_status", "source_code").select("ai", F.lit("header").alias("kind"), F.coalesce(F.col("latest_compile_status") == "success", F.lit(False)).alias("ok"), loc("source_code"))
    m = load(spark, sf, "methods", "ai", "mapping_status", "code").select("ai", F.lit("method").alias("kind"), F.coalesce(F.col("mapping_status") == "already_implemented", F.lit(False)).alias("ok"), loc("code"))
    g = h.union(m).groupingSets([["ai", "kind"], ["ai"]], "ai", "kind").agg(F.grouping("kind").alias("g"), F.count(F.lit(1)).alias("total"), F.sum("loc").alias("total_loc"), F.round(metrics.rate(F.col("ok")), 6).alias("rate"), F.round(metrics.ratio(F.sum(F.when(F.col("ok"), F.col("loc")).otherwise(0)), F.sum("loc"), 0.0), 6).alias("loc_rate"))
    return g.select("ai", F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "total", "total_loc", "rate", "loc_rate")


@query("SELECT project, run_id, header_key, count(*) AS n_attempts, arg_min(coalesce(success, false), (round, feedback_id)) AS first_ok, arg_max(coalesce(success, false), (round, feedback_id)) AS final_ok, min(CASE WHEN coalesce(success, false) THEN (round, feedback_id).round END) AS solved_at FROM compile_feedback WHERE round IS NOT NULL GROUP BY ALL".replace("(round, feedback_id).round", "round").replace("(round, feedback_id)", "round::BIGINT * 1000000000 + feedback_id"))
def attempt_replay(spark, sf):
    """First and final outcome of each header's attempts, and the round that solved it."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "success").where("round is not null")
    a = f.select(*RUN, "header_key", (F.col("round").cast("long") * 1_000_000_000 + F.col("feedback_id")).alias("attempt"), F.col("success").alias("ok"), "round")
    s = reports.attempts_summary(a, [*RUN, "header_key"])
    return s.withColumn("solved_at", F.floor(F.col("solved_at") / 1_000_000_000).cast("int"))


@query("SELECT m.project, m.run_id, m.header_key, count(*) AS n_methods, count(*) FILTER (mapping_status = 'unmapped') AS n_unmapped, bool_and(mapping_status IS NOT NULL AND mapping_status <> 'unmapped') AS complete FROM methods m GROUP BY ALL")
def mapping_completeness(spark, sf):
    m = load(spark, sf, "methods", *RUN, "header_key", "mapping_status")
    ok = F.coalesce(F.col("mapping_status") != "unmapped", F.lit(False))
    return m.groupBy(*RUN, "header_key").agg(F.count(F.lit(1)).alias("n_methods"), F.count_if(F.col("mapping_status") == "unmapped").alias("n_unmapped"), F.bool_and(ok).alias("complete"))


@query("SELECT ai, mapping_status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY ai), 6) AS pct FROM methods GROUP BY ai, mapping_status")
def mapping_status_share(spark, sf):
    m = load(spark, sf, "methods", "ai", "mapping_status").groupBy("ai", "mapping_status").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("ai")), 6))


@query("SELECT * EXCLUDE (rn) FROM (SELECT file_name, tier, row_number() OVER (PARTITION BY project, run_id ORDER BY tier, result_id) AS position, project, run_id, row_number() OVER (PARTITION BY project, run_id, file_name ORDER BY tier, result_id) AS rn FROM (SELECT *, CASE WHEN kind = 'header' AND EXISTS (SELECT 1 FROM headers h WHERE h.project = r.project AND h.run_id = r.run_id AND list_contains(h.include_dependencies, r.file_name)) THEN 0 WHEN kind = 'header' THEN 1 ELSE 2 END AS tier FROM compile_result r WHERE NOT coalesce(success, true)) t) x WHERE rn = 1".replace("row_number() OVER (PARTITION BY project, run_id ORDER BY tier, result_id) AS position, ", ""))
def repair_priority(spark, sf):
    """Failing files by priority: headers that others include, other headers, implementation files."""
    r = load(spark, sf, "compile_result", "result_id", *RUN, "kind", "file_name", "success").where(~F.coalesce("success", F.lit(True)))
    inc = load(spark, sf, "headers", *RUN, "include_dependencies").select(*RUN, F.explode("include_dependencies").alias("file_name")).where("file_name is not null").distinct().withColumn("used", F.lit(True))
    x = r.join(inc, [*RUN, "file_name"], "left")
    tier = F.when((F.col("kind") == "header") & F.coalesce("used", F.lit(False)), 0).when(F.col("kind") == "header", 1).otherwise(2)
    return x.groupBy(*RUN, "file_name").agg(F.min(tier).alias("tier"))


@query("SELECT DISTINCT user_id, ts::DATE AS day, count(*) OVER w AS n_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_counts(spark, sf):
    """Events of each user up to each day."""
    d = load(spark, sf, "events", "user_id", "ts").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", "day", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")).alias("n_so_far"))


@query(core._error_share_sql().replace("SELECT ai, error_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY ai), 6) AS pct FROM c", "SELECT ai, error_type, n, dense_rank() OVER (PARTITION BY ai ORDER BY n DESC) AS rank FROM c"))
def error_class_rank(spark, sf):
    c = core.classified(spark, sf).groupBy("ai", "error_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.dense_rank().over(Window.partitionBy("ai").orderBy(F.desc("n"))).cast("long"))


@query("SELECT DISTINCT header_key, array_to_string(list_distinct_keep, ';') AS candidates FROM (SELECT header_key, CASE WHEN contains(header_key, '$') THEN [header_key, regexp_extract(header_key, '([^$]*)$', 1), replace(header_key, '$', '::')] ELSE [header_key] END AS list_distinct_keep FROM headers WHERE header_key IS NOT NULL) x")
def name_candidates(spark, sf):
    h = load(spark, sf, "headers", "header_key").where("header_key is not null").distinct()
    return h.select("header_key", F.array_join(text.name_candidates(F.col("header_key")), ";").alias("candidates"))


# ------------------------------------------------------------------ streaming
@query("SELECT coalesce(nullif(trim(stage), ''), 'unclassified') AS stage, count(*) AS n_calls, CAST(sum(ceil(length(coalesce(log_output, '')) / 4.0)) AS BIGINT) AS total_tokens FROM compile_result GROUP BY 1")
def streaming_stage_totals(spark, sf):
    s = ingest.stream_table(spark, sf, "compile_result")
    t = s.select("stage", F.ceil(F.length(F.coalesce("log_output", F.lit(""))) / 4.0).alias("total_tokens"))
    return ingest.run_to_end(ingest.stage_totals(t), "complete", "stage-totals")


@query("SELECT date_trunc('day', recorded_at AT TIME ZONE 'UTC')::DATE AS day, stage, count(*) AS n, count(*) FILTER (success) AS n_ok FROM compile_result WHERE recorded_at IS NOT NULL GROUP BY ALL")
def streaming_daily_windows(spark, sf):
    s = ingest.stream_table(spark, sf, "compile_result").select("recorded_at", "stage", "success")
    return ingest.run_to_end(ingest.windowed_results(s), "complete", "daily-windows").select(F.to_date("w.start").alias("day"), "stage", "n", "n_ok")


@query("SELECT result_id, project, run_id, file_name, success FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, file_name ORDER BY recorded_at DESC NULLS LAST, result_id DESC) AS rn FROM compile_result) x WHERE rn = 1")
def streaming_upsert(spark, sf):
    s = ingest.stream_table(spark, sf, "compile_result").select("result_id", *RUN, "file_name", "success", "recorded_at")
    return ingest.upsert_latest(spark, s, [*RUN, "file_name"], ["recorded_at", "result_id"]).select("result_id", *RUN, "file_name", "success")


@query("""WITH m AS (SELECT date_trunc('day', recorded_at AT TIME ZONE 'UTC') AS day, stage, count(*) AS n FROM compile_result WHERE recorded_at IS NOT NULL GROUP BY ALL)
  SELECT day::DATE AS day, stage, n FROM m WHERE day + INTERVAL 1 DAY <= (SELECT max(date_trunc('milliseconds', recorded_at AT TIME ZONE 'UTC')) - INTERVAL 30 DAY FROM compile_result)""")
def streaming_closed_windows(spark, sf):
    """Windows put out once, when the watermark has passed them: those of the last thirty days stay open."""
    s = ingest.stream_table(spark, sf, "compile_result").select("recorded_at", "stage", "success").where("recorded_at is not null")
    return ingest.run_to_end(ingest.windowed_results(s), "append", "closed-windows").select(F.to_date("w.start").alias("day"), "stage", "n")


@query("""WITH r AS (SELECT project, file_name, recorded_at, success, lag(success) OVER (PARTITION BY project, file_name ORDER BY recorded_at, success) AS before FROM (SELECT DISTINCT project, file_name, recorded_at, success FROM compile_result WHERE success IS NOT NULL AND project IS NOT NULL AND file_name IS NOT NULL AND recorded_at IS NOT NULL) d)
  SELECT project, file_name, count(*) AS n_changes FROM r WHERE before IS NULL OR before <> success GROUP BY ALL""")
def streaming_status_changes(spark, sf):
    """How often each file's outcome changed, by an operator that keeps the last one."""
    s = ingest.stream_table(spark, sf, "compile_result").select("project", "file_name", "recorded_at", "success").where("success is not null and project is not null and file_name is not null and recorded_at is not null")
    return ingest.run_to_end(ingest.status_changes(s, ["project", "file_name"]), "append", "changes").groupBy("project", "file_name").agg(F.count(F.lit(1)).alias("n_changes"))
