"""Queries on declarations, predicates and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import declarations, predicates, text
from ..operators import callgraph
from ..tables import Stage, load
from .core_queries import RUN, inheritance_edges, inner, query

STRINGS = T.ArrayType(T.StringType())


@query("SELECT method_id, coalesce(contains(code, '{') AND NOT regexp_matches(code, '^\\s*(?:@\\w+\\s*)*(?:[\\w<>\\[\\], ]+\\s)?abstract\\s'), false) AS concrete, coalesce(trim(raw_translated_code), '') <> '' AS translated, coalesce(lower(trim(is_simple_method::VARCHAR)) IN ('1', 'true', 'yes'), false) AS simple, coalesce(contains(code, regexp_extract(method_key, ':([^(]*)', 1)) AND contains(code, '(') AND contains(code, '{') AND contains(code, '}'), false) AS looks_right FROM methods")
def predicate_flags(spark, sf):
    m = load(spark, sf, "methods", "method_id", "code", "raw_translated_code", "is_simple_method", "method_key")
    return m.select("method_id", predicates.concrete_body(F.col("code")).alias("concrete"), predicates.filled(F.col("raw_translated_code")).alias("translated"), predicates.as_bool(F.col("is_simple_method")).alias("simple"), predicates.looks_like_method(F.col("code"), F.regexp_extract("method_key", r":([^(]*)", 1)).alias("looks_right"))


@query("SELECT header_id, coalesce(source_kind = 'generated_external' OR header_type = 'generated_external', false) AS generated, coalesce(source_kind = 'manual_stub', false) AS stub, NOT coalesce(source_kind = 'generated_external' OR header_type = 'generated_external', false) AND NOT coalesce(source_kind = 'manual_stub', false) AS source FROM headers")
def header_kinds(spark, sf):
    h = load(spark, sf, "headers", "header_id", "source_kind", "header_type")
    k, t = F.col("source_kind"), F.col("header_type")
    return h.select("header_id", predicates.is_generated(k, t).alias("generated"), predicates.is_stub(k).alias("stub"), predicates.is_source(k, t).alias("source"))


@query("SELECT project, run_id, count(*) FILTER (file_name NOT LIKE '\\_\\_%' ESCAPE '\\') AS n_production, count(*) FILTER (success IS NOT NULL) AS n_measured, bool_and(success IS NOT NULL) AS all_measured FROM compile_result GROUP BY ALL")
def measured_runs(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "file_name", "success")
    return r.groupBy(*RUN).agg(F.count_if(~F.col("file_name").startswith("__")).alias("n_production"), F.count_if(F.col("success").isNotNull()).alias("n_measured"), F.bool_and(F.col("success").isNotNull()).alias("all_measured"))


@query("""WITH k AS (SELECT project, run_id, method_key, min(method_id) AS id FROM methods WHERE method_key IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, regexp_replace(regexp_extract(method_key, '^([^:]*):', 1), '\\$[0-9]+', '', 'g') || ':' || regexp_extract(method_key, ':([^(]*)', 1) AS loose FROM k)
  SELECT a.project, a.run_id, a.method_key, min(b.method_key) AS foreign_key, count(*) AS n FROM c a JOIN c b ON a.project = b.project AND a.run_id = b.run_id AND regexp_extract(a.method_key, ':(.*)$', 1) = regexp_extract(b.method_key, ':(.*)$', 1) AND a.loose <> b.loose GROUP BY ALL""")
def foreign_overrides(spark, sf):
    """The same signature in another class of the run; anonymous qualifiers do not count."""
    k = load(spark, sf, "methods", *RUN, "method_key").where("method_key is not null").distinct()
    owner = F.regexp_replace(F.regexp_extract("method_key", r"^([^:]*):", 1), r"\$[0-9]+", "")
    k = k.select(*RUN, "method_key", F.regexp_extract("method_key", r":(.*)$", 1).alias("sig"), F.concat(owner, F.lit(":"), F.regexp_extract("method_key", r":([^(]*)", 1)).alias("loose"))
    # per signature the two classes with the smallest keys and how many methods each has: no pairs
    cls = k.groupBy(*RUN, "sig", "loose").agg(F.min("method_key").alias("least"), F.count(F.lit(1)).alias("m"))
    two = cls.groupBy(*RUN, "sig").agg(F.min(F.struct("least", "loose")).alias("one"), F.sum("m").alias("n_all"), F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1")
    second = cls.join(two, [*RUN, "sig"]).where(F.col("loose") != F.col("one.loose")).groupBy(*RUN, "sig").agg(F.min("least").alias("second"))
    j = k.join(cls.select(*RUN, "sig", "loose", "m"), [*RUN, "sig", "loose"]).join(two, [*RUN, "sig"]).join(second, [*RUN, "sig"])
    return j.select(*RUN, "method_key", F.when(F.col("loose") == F.col("one.loose"), F.col("second")).otherwise(F.col("one.least")).alias("foreign_key"), (F.col("n_all") - F.col("m")).alias("n"))


@query("""WITH m AS (SELECT DISTINCT project, run_id, method_key, regexp_replace(method_key, '\\.\\.\\.|\\[\\]', '*', 'g') AS loose FROM methods WHERE method_key IS NOT NULL)
  SELECT project, run_id, loose, min(method_key) AS method_key FROM m GROUP BY project, run_id, loose HAVING count(*) = 1""")
def varargs_unique(spark, sf):
    """Methods that stay unique when arrays and varargs are taken for one."""
    m = load(spark, sf, "methods", *RUN, "method_key").where("method_key is not null").distinct().withColumn("loose", F.regexp_replace("method_key", r"\.\.\.|\[\]", "*"))
    return m.groupBy(*RUN, "loose").agg(F.min("method_key").alias("method_key"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("""WITH i AS (SELECT project, run_id, header_key, unnest(imports) AS imp FROM headers),
  l AS (SELECT DISTINCT project, run_id, header_key, regexp_extract(imp, '^(?:static\\s+)?(java\\.(?:util|io|lang|time|math|nio))', 1) AS library FROM i WHERE imp IS NOT NULL)
  SELECT library, count(*) AS n_headers, CASE library WHEN 'java.util' THEN 'available' WHEN 'java.lang' THEN 'available' WHEN 'java.math' THEN 'missing' ELSE 'partial' END AS availability FROM l WHERE library <> '' GROUP BY library""")
def library_lookup(spark, sf):
    """Imports of the platform looked up in a small table of what exists on the other side."""
    table = spark.createDataFrame([("java.util", "available"), ("java.lang", "available"), ("java.math", "missing")], "library string, availability string")
    i = load(spark, sf, "headers", *RUN, "header_key", "imports").select(*RUN, "header_key", F.explode("imports").alias("imp")).where("imp is not null")
    lib = i.select(*RUN, "header_key", F.regexp_extract("imp", r"^(?:static\s+)?(java\.(?:util|io|lang|time|math|nio))", 1).alias("library")).where("library <> ''").distinct()
    n = lib.groupBy("library").agg(F.count(F.lit(1)).alias("n_headers"))
    return n.join(F.broadcast(table), "library", "left").select("library", "n_headers", F.coalesce("availability", F.lit("partial")).alias("availability"))


@query("""WITH g AS (SELECT DISTINCT project, run_id, header_key FROM headers WHERE source_kind IN ('generated_external', 'manual_stub')), s AS (SELECT DISTINCT project, run_id, header_key FROM headers WHERE source_kind = 'java')
  SELECT coalesce(g.project, s.project) AS project, coalesce(g.run_id, s.run_id) AS run_id, coalesce(g.header_key, s.header_key) AS header_key, CASE WHEN s.header_key IS NOT NULL THEN 'source' ELSE 'placeholder' END AS chosen FROM g FULL OUTER JOIN s ON g.project = s.project AND g.run_id = s.run_id AND g.header_key = s.header_key""")
def stub_injection(spark, sf):
    """A source wins over a stub or generated placeholder of the same name."""
    h = load(spark, sf, "headers", *RUN, "header_key", "source_kind")
    kind = F.when(F.col("source_kind") == "java", 0).when(F.col("source_kind").isin("generated_external", "manual_stub"), 1)
    return h.withColumn("k", kind).where("k is not null").groupBy(*RUN, "header_key").agg(F.min("k").alias("k")).select(*RUN, "header_key", F.when(F.col("k") == 0, "source").otherwise("placeholder").alias("chosen"))


@query("""WITH n AS (SELECT project, run_id, file_name, regexp_replace(file_name, '\\.(h|cpp)$', '') AS stem, log_output FROM compile_result WHERE log_output IS NOT NULL AND file_name IS NOT NULL)
  SELECT DISTINCT project, run_id, file_name, CAST((length(log_output) - length(replace(log_output, stem, ''))) / length(stem) AS BIGINT) AS n_mentions FROM n WHERE length(stem) > 0""")
def log_mentions(spark, sf):
    """How often a log names its own file."""
    r = load(spark, sf, "compile_result", *RUN, "file_name", "log_output").where("log_output is not null and file_name is not null").withColumn("stem", F.regexp_replace("file_name", r"\.(h|cpp)$", "")).where("length(stem) > 0")
    n = ((F.length("log_output") - F.length(F.replace("log_output", "stem", F.lit("")))) / F.length("stem")).cast("long")
    return r.select(*RUN, "file_name", n.alias("n_mentions")).distinct()


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, printf('%.2f', sum(value)) AS total, coalesce(printf('%.1f%%', 100.0 * count(*) FILTER (value > 10) / count(*)), '-') AS share FROM events GROUP BY event_type")
def formatted_numbers(spark, sf):
    e = load(spark, sf, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.count_if(F.col("value") > 10).alias("k"))
    return e.select("event_type", "n", predicates.number(F.col("s")).alias("total"), predicates.number(100.0 * F.col("k") / F.col("n"), "%.1f%%").alias("share"))


@query("SELECT method_id, code FROM methods WHERE (starts_with(lower(method_key), 'warm') AND NOT contains(code, 'switch')) OR length(code) > 1500")
def filter_language(spark, sf):
    """Rows kept by a filter of the call-graph tools' language."""
    cond = predicates.filter_expression("string.startsWithIC(method_key, 'Warm') && !string.contains(code, 'switch') || string.length(code) > 1500")
    return load(spark, sf, "methods", "method_id", "method_key", "code").where(cond).select("method_id", "code")


@query()
def cycles(spark, sf):
    """Cycles of calls that a depth-first search closes, in canonical form, each component searched for itself."""
    return callgraph.component_cycles(spark, Stage(spark, "calls").put(inner(spark, sf)))


def _cpp(c: str) -> str:
    """Java types in C++, in SQL: arrays, generic names, plain names. The types of method keys hold no wildcards."""
    c = f"regexp_replace(regexp_replace({c}, '^(.*?)(?:\\[\\])+$', 'std::vector<\\1>'), '^(.*)\\.\\.\\.$', 'std::vector<\\1>')"
    for cpp, names in (("vector", "List|ArrayList|Collection|Iterable"), ("list", "LinkedList"), ("set", "Set|HashSet|TreeSet"), ("map", "Map|HashMap|TreeMap"), ("optional", "Optional"), ("deque", "Queue|Deque")):
        c = f"regexp_replace({c}, '\\b(?:{names})<', 'std::{cpp}<', 'g')"
    plain = [("bool", "boolean|Boolean"), ("char", "byte|Byte|Character"), ("@", "long|Long"), ("int", "Integer"), ("short", "Short"), ("float", "Float"), ("double", "Double"), ("std::string", "String"), ("void*", "Object|Class|Function")]
    for cpp, names in plain:
        c = f"regexp_replace({c}, '\\b(?:{names})\\b', '{cpp}', 'g')"
    return f"replace(replace({c}, ',', ', '), '@', 'long long')"


_TYPES = "SELECT DISTINCT method_key, regexp_replace(regexp_replace(regexp_extract(method_key, '\\((.*)\\)', 1), '\\s+', '', 'g'), '<([^<>]*),([^<>]*)>', '<\\1;\\2>', 'g') AS args FROM methods WHERE method_key IS NOT NULL"
_NEEDS = ["list", "map", "optional", "set", "string", "vector"]


@query(f"SELECT java_type, n, cpp_type, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(cpp_type, {chr(39)}std::{x}{chr(39)}) THEN {chr(39)}{x}{chr(39)} END' for x in _NEEDS)}], lambda v: v IS NOT NULL), ';') AS includes FROM (SELECT java_type, n, {_cpp('java_type')} AS cpp_type FROM (SELECT java_type, count(*) AS n FROM (SELECT replace(regexp_extract(unnest(string_split(args, ',')), '((?:[A-Z]\\w*\\.)*[^.]*|.*\\.\\.\\.)$', 1), ';', ',') AS java_type FROM ({_TYPES}) t WHERE args <> '') u GROUP BY java_type) v) w")
def type_mapping(spark, sf):
    """Each parameter type of the table in C++, with the headers it needs."""
    params = text.batch(text.java_parameters, STRINGS)
    m = load(spark, sf, "methods", "method_key").where("method_key is not null").distinct()
    t = m.select(F.explode(params(F.col("method_key"))).alias("java_type")).groupBy("java_type").agg(F.count(F.lit(1)).alias("n"))
    cpp, inc = text.batch(declarations.map_type), text.batch(lambda x: ";".join(declarations.std_includes(declarations.map_type(x))))
    return t.select("java_type", "n", cpp(F.col("java_type")).alias("cpp_type"), inc(F.col("java_type")).alias("includes"))


_BARE = "regexp_replace(source_code, '(\"(?:\\\\.|[^\"\\\\\\n])*\"|''(?:\\\\.|[^''\\\\\\n])*'')|//[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*(?:\\*+/|$)', '\\1', 'g')"
_CLAUSE_RE = "\\b(?:class|interface|enum)\\s+([A-Za-z_]\\w*)(?:<[^{]*?>)?\\s*(?:extends\\s+([^{]+?))?\\s*(?:implements\\s+([^{]+?))?\\s*\\{"
_parts = lambda k: f"list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(b, '{_CLAUSE_RE}', {k}), '<([^<>]*),([^<>]*)>', '<\\1;;\\2>', 'g'), '<([^<>]*),([^<>]*)>', '<\\1;;\\2>', 'g'), ','), lambda x: trim(replace(x, ';;', ',')))"


@query(f"SELECT header_id, regexp_extract(b, '{_CLAUSE_RE}', 1) AS type_name, {_parts(2)}[1] AS extended, array_to_string(list_filter(list_concat({_parts(2)}[2:], {_parts(3)}), lambda x: x <> ''), ';') AS implemented FROM (SELECT header_id, {_BARE} AS b FROM headers WHERE source_code IS NOT NULL AND coalesce(source_kind, 'java') = 'java') h")
def inheritance_clauses(spark, sf):
    clause = text.batch(lambda s: [x or "" for x in (lambda r: [r[0], r[1], ";".join(r[2])])(declarations.inheritance(s))], STRINGS)
    h = load(spark, sf, "headers", "header_id", "source_code", "source_kind").where("source_code is not null and coalesce(source_kind, 'java') = 'java'").withColumn("c", clause(F.col("source_code")))
    return h.select("header_id", F.col("c")[0].alias("type_name"), F.col("c")[1].alias("extended"), F.col("c")[2].alias("implemented"))


@query()
def member_declarations(spark, sf):
    """Functions that generated and stub headers declare."""

    def found(s: str) -> list[str]:
        name = declarations.inheritance(s)[0]
        body = declarations.class_body(s, name) if name else None
        return [f"{p[0]}({','.join(p[1])})" for d in declarations.members(body if body is not None else s) if (p := declarations.parse_declaration(d))]

    h = load(spark, sf, "headers", "header_id", "source_code", "source_kind").where("source_code is not null and coalesce(source_kind, '') <> 'java'")
    return h.select("header_id", F.posexplode(text.batch(found, STRINGS)(F.col("source_code"))).alias("pos", "declaration"))


@query()
def statement_counts(spark, sf):
    n = text.batch(declarations.statements, T.IntegerType())
    return load(spark, sf, "methods", "method_id", "code").where("code is not null").select("method_id", n(F.col("code")).alias("n_statements"))


@query()
def header_skeletons(spark, sf):
    """Outlines of the runs' source headers from their method keys."""
    m = load(spark, sf, "methods", *RUN, "header_key", "method_key", "code").where("method_key is not null").groupBy(*RUN, "header_key", "method_key").agg(F.min("code").alias("code"))
    m = m.groupBy(*RUN, "header_key").agg(F.sort_array(F.collect_list(F.struct("method_key", "code"))).alias("keys"))
    h = load(spark, sf, "headers", *RUN, "header_key", "header_type", "source_kind").where("source_kind = 'java'").select(*RUN, "header_key", "header_type").dropDuplicates([*RUN, "header_key"])
    e = inheritance_edges(spark, sf).groupBy(*RUN, F.col("child").alias("header_key")).agg(F.sort_array(F.collect_set("parent")).alias("bases"))
    x = h.join(m, [*RUN, "header_key"], "left").join(e, [*RUN, "header_key"], "left")

    def build(batches):
        for pdf in batches:
            short = lambda k: k.split("$")[-1]
            pdf["skeleton"] = [declarations.skeleton(short(k), t or "class", [short(b) for b in (bs if bs is not None else [])], [(x["method_key"], x["code"]) for x in ks] if ks is not None else []) for k, t, bs, ks in zip(pdf["header_key"], pdf["header_type"], pdf["bases"], pdf["keys"])]
            yield pdf[["project", "run_id", "header_key", "skeleton"]]

    return x.mapInPandas(build, "project string, run_id string, header_key string, skeleton string")
