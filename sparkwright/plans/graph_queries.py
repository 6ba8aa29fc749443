"""Queries over whole graphs, states, contexts and evaluation rows, each beside the same question in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import callgraph, contexts, mapping, metrics
from ..tables import Stage, load
from . import core_queries as core
from .core_queries import RUN, SQL, query

# ------------------------------------------------------------------ SQL of keys, cycles and layers


def _erased(c: str) -> str:
    c = f"regexp_replace({c}, '\\s+', '', 'g')"
    for _ in range(4):
        c = f"regexp_replace({c}, '<[^<>]*>', '', 'g')"
    return f"regexp_replace({c}, '(?:[A-Za-z_]\\w*\\.)+([A-Za-z_])', '\\1', 'g')"


_TARGET = "regexp_replace(dst, '^\\([A-Z]*\\)', '')"
_NODES = "nodes AS (SELECT DISTINCT project, run_id, method_key AS node, ord FROM methods WHERE method_key IS NOT NULL)"


def _wired(nodes: str) -> str:
    """CTEs ``known``, ``res`` and ``e`` (inner edges) from a CTE of (project, run_id, node, ord)."""
    return f"""known AS (SELECT project, run_id, key, node FROM (SELECT project, run_id, {_erased("node")} AS key, node, row_number() OVER (PARTITION BY project, run_id, {_erased("node")} ORDER BY ord NULLS LAST, node) AS rn FROM {nodes}) x WHERE rn = 1),
  calls AS (SELECT DISTINCT project, run_id, {_erased("src")} AS sk, {_erased(_TARGET)} AS dk FROM call_edge WHERE src IS NOT NULL AND dst IS NOT NULL),
  res AS (SELECT c.project, c.run_id, coalesce(a.node, sk) AS src, coalesce(b.node, dk) AS dst, CASE WHEN a.node IS NOT NULL AND b.node IS NOT NULL THEN 'inner' WHEN a.node IS NOT NULL THEN 'external' WHEN b.node IS NOT NULL THEN 'caller_missing' ELSE 'both_missing' END AS outcome
    FROM calls c LEFT JOIN known a ON a.project = c.project AND a.run_id = c.run_id AND a.key = sk LEFT JOIN known b ON b.project = c.project AND b.run_id = c.run_id AND b.key = dk WHERE sk <> dk),
  e AS (SELECT project, run_id, src, dst FROM res WHERE outcome = 'inner')"""


#: From edges ``e``: closure ``r``, components ``c``, layers ``lay`` of linked nodes.
_LAYERED = """r AS (SELECT project, run_id, src, dst FROM e UNION SELECT r.project, r.run_id, r.src, e.dst FROM r JOIN e ON e.project = r.project AND e.run_id = r.run_id AND e.src = r.dst),
  linked AS (SELECT project, run_id, src AS node FROM e UNION SELECT project, run_id, dst FROM e),
  mutual AS (SELECT x.project, x.run_id, x.src AS node, x.dst AS other FROM r x JOIN r y ON x.project = y.project AND x.run_id = y.run_id AND x.src = y.dst AND x.dst = y.src),
  c AS (SELECT l.project, l.run_id, l.node, least(l.node, coalesce(min(m.other), l.node)) AS component, 1 + count(DISTINCT CASE WHEN m.other <> l.node THEN m.other END) AS size FROM linked l LEFT JOIN mutual m ON m.project = l.project AND m.run_id = l.run_id AND m.node = l.node GROUP BY l.project, l.run_id, l.node),
  ce AS (SELECT DISTINCT e.project, e.run_id, a.component AS ca, b.component AS cb FROM e JOIN c a ON a.project = e.project AND a.run_id = e.run_id AND a.node = e.src JOIN c b ON b.project = e.project AND b.run_id = e.run_id AND b.node = e.dst WHERE a.component <> b.component),
  lv AS (SELECT DISTINCT project, run_id, component, 0 AS lvl FROM c UNION SELECT ce.project, ce.run_id, ce.ca, lv.lvl + 1 FROM lv JOIN ce ON ce.project = lv.project AND ce.run_id = lv.run_id AND ce.cb = lv.component),
  lay AS (SELECT c.project, c.run_id, c.node, c.component, c.size, max(lv.lvl) AS layer FROM c JOIN lv USING (project, run_id, component) GROUP BY ALL)"""

_BUILT = "SELECT n.project, n.run_id, n.node, CAST(coalesce(l.size, 1) AS INTEGER) AS component_size, CAST(coalesce(l.layer, 0) AS INTEGER) AS layer FROM (SELECT DISTINCT project, run_id, node FROM {nodes}) n LEFT JOIN lay l USING (project, run_id, node)"


def _ordered(nodes: str) -> str:
    """Dependencies first, cycles together, else the recorded order; from ``lay`` and a CTE of (project, run_id, node, ord)."""
    return f"""SELECT project, run_id, node, CAST(layer AS INTEGER) AS layer, CAST(row_number() OVER (PARTITION BY project, run_id ORDER BY layer, head, rk) AS INTEGER) AS position FROM (
    SELECT *, min(rk) OVER (PARTITION BY project, run_id, component) AS head FROM (
      SELECT n.project, n.run_id, n.node, coalesce(l.component, n.node) AS component, coalesce(l.layer, 0) AS layer, row_number() OVER (PARTITION BY n.project, n.run_id ORDER BY n.ord NULLS LAST, n.node) AS rk FROM {nodes} n LEFT JOIN lay l USING (project, run_id, node)) a) b"""


def _methods(spark, sf):
    return load(spark, sf, "methods", *RUN, "method_key", "ord")


def _calls(spark, sf):
    return load(spark, sf, "call_edge", *RUN, "src", "dst")


# ------------------------------------------------------------------ the graph and what changes it
@query(f"WITH {_NODES}, {_wired('nodes')} SELECT * FROM res")
def erased_edges(spark, sf):
    """Calls resolved on keys without type arguments and packages; overloads that become equal share the first of them."""
    return callgraph.resolve_erased(_calls(spark, sf), _methods(spark, sf), "ord")


@query(f"WITH {_NODES}, {_wired('nodes')} SELECT DISTINCT c.project, c.run_id, c.dk AS key, k.node FROM calls c JOIN known k ON k.project = c.project AND k.run_id = c.run_id AND k.key = c.dk")
def erased_lookup(spark, sf):
    """Each called key that a method answers, and the first such method."""
    known = callgraph.first_by_key(_methods(spark, sf), "ord")
    called = _calls(spark, sf).where("src is not null and dst is not null").select(*RUN, callgraph.erased_key(callgraph.strip_type(F.col("dst"))).alias("key")).distinct()
    return called.join(known, [*RUN, "key"]).select(*RUN, "key", "node")


@query(f"WITH RECURSIVE {_NODES}, {_wired('nodes')}, {_LAYERED} {_BUILT.format(nodes='nodes')}")
def graph_build(spark, sf):
    """From class rows and recorded calls to the layered graph."""
    return callgraph.built_graph(spark, _calls(spark, sf), _methods(spark, sf), "ord").drop("component")


_OWNERS = "owners AS (SELECT DISTINCT project, run_id, regexp_extract(header_key, '([^$.]*)$', 1) AS owner FROM headers WHERE header_key IS NOT NULL)"


@query(f"""WITH RECURSIVE {_NODES}, {_wired('nodes').replace("known AS", "known0 AS").replace("JOIN known ", "JOIN known0 ").replace("calls AS", "calls0 AS").replace("FROM calls c", "FROM calls0 c").replace("res AS", "res0 AS").replace("FROM res ", "FROM res0 ").replace("e AS (SELECT project, run_id, src, dst", "e0 AS (SELECT project, run_id, src, dst")},
  {_OWNERS}, more AS (SELECT * FROM nodes UNION SELECT DISTINCT x.project, x.run_id, x.dst, NULL FROM res0 x JOIN owners o ON o.project = x.project AND o.run_id = x.run_id AND o.owner = regexp_extract(x.dst, '^([^:]*):', 1) WHERE x.outcome = 'external'),
  {_wired('more')}, {_LAYERED} {_BUILT.format(nodes='more')}""")
def rewired_layers(spark, sf):
    """Members that only calls know are added to the classes of the project; the graph is wired and layered anew."""
    owners = load(spark, sf, "headers", *RUN, "header_key").where("header_key is not null").select(*RUN, F.regexp_extract("header_key", r"([^$.]*)$", 1).alias("owner"))
    nodes = callgraph.injected(_calls(spark, sf), _methods(spark, sf), owners, "ord")
    return callgraph.built_graph(spark, _calls(spark, sf), nodes, "ord").drop("component")


_HEADS = "heads AS (SELECT project, run_id, {key} AS node, min(ord) AS ord FROM headers WHERE header_key IS NOT NULL GROUP BY ALL)"
_INCLUDES = "e AS (SELECT DISTINCT d.project, d.run_id, d.src, d.dst FROM (SELECT project, run_id, replace(header_key, '$', '_') AS src, regexp_replace(unnest(include_dependencies), '\\.(h|hpp)$', '') AS dst FROM headers) d JOIN heads h ON h.project = d.project AND h.run_id = d.run_id AND h.node = d.dst WHERE d.src <> d.dst)"


@query(f"WITH RECURSIVE {_HEADS.format(key=chr(39).join(['replace(header_key, ', '$', ', ', '_', ')']))}, {_INCLUDES}, {_LAYERED} {_ordered('heads')}")
def planned_order(spark, sf):
    """Headers by their translated includes, any key and dependencies being columns."""
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies", "ord")
    deps = F.transform("include_dependencies", lambda x: F.regexp_replace(x, r"\.(h|hpp)$", ""))
    return callgraph.dependency_order(spark, h, F.translate("header_key", "$", "_"), deps, "ord").drop("component")


@query(f"WITH RECURSIVE {_HEADS.format(key='header_key')}, e AS (SELECT DISTINCT d.project, d.run_id, d.src, d.dst FROM (SELECT project, run_id, header_key AS src, regexp_extract(unnest(imports), '([^.]*)$', 1) AS dst FROM headers) d JOIN heads h ON h.project = d.project AND h.run_id = d.run_id AND h.node = d.dst WHERE d.src <> d.dst), {_LAYERED} {_ordered('heads')}")
def header_order(spark, sf):
    """Headers by their original imports, the imported ones first."""
    h = load(spark, sf, "headers", *RUN, "header_key", "imports", "ord")
    return callgraph.dependency_order(spark, h, F.col("header_key"), F.transform("imports", lambda x: F.regexp_extract(x, r"([^.]*)$", 1)), "ord").drop("component")


def _includes(spark, sf):
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies")
    d = h.select(*RUN, F.translate("header_key", "$", "_").alias("src"), F.explode("include_dependencies").alias("inc")).where("inc is not null").select(*RUN, "src", F.regexp_replace("inc", r"\.(h|hpp)$", "").alias("dst")).where("src <> dst").distinct()
    return d.join(h.where("header_key is not null").select(*RUN, F.translate("header_key", "$", "_").alias("dst")).distinct(), [*RUN, "dst"]).select(*RUN, "src", "dst")


@query(f"WITH RECURSIVE {_HEADS.format(key=chr(39).join(['replace(header_key, ', '$', ', ', '_', ')']))}, {_INCLUDES}, r AS (SELECT * FROM e UNION SELECT r.project, r.run_id, r.src, e.dst FROM r JOIN e ON e.project = r.project AND e.run_id = r.run_id AND e.src = r.dst) SELECT e.project, e.run_id, e.src, e.dst, CASE WHEN b.src IS NULL THEN 'include' ELSE 'forward_declare' END AS how FROM e LEFT JOIN r b ON b.project = e.project AND b.run_id = e.run_id AND b.src = e.dst AND b.dst = e.src")
def include_breaking(spark, sf):
    """Includes that lie on a cycle become forward declarations: both ends are of one component then."""
    e = Stage(spark, "includes").put(_includes(spark, sf))
    c = callgraph.layers(spark, e).select(*RUN, "node", "component")
    j = e.join(c.withColumnsRenamed({"node": "src", "component": "a"}), [*RUN, "src"]).join(c.withColumnsRenamed({"node": "dst", "component": "b"}), [*RUN, "dst"])
    return j.select(*RUN, "src", "dst", F.when(F.col("a") == F.col("b"), "forward_declare").otherwise("include").alias("how"))


_IMPORTS = f"e AS (SELECT DISTINCT project, run_id, header_key AS src, target AS dst FROM ({SQL['import_edges']}) i)"


@query(f"WITH RECURSIVE {_IMPORTS}, {_LAYERED} SELECT project, run_id, count(*) AS n_types, max((SELECT count(*) FROM e WHERE e.project = lay.project AND e.run_id = lay.run_id)) AS n_edges, count(*) FILTER (size > 1) AS n_on_cycles, bool_or(size > 1) AS has_cycle FROM lay GROUP BY project, run_id")
def import_cycle_summary(spark, sf):
    """Types, imports and cycles of each run's import graph."""
    e = Stage(spark, "imports").put(core.import_edges(spark, sf).select(*RUN, F.col("header_key").alias("src"), F.col("target").alias("dst")).distinct())
    lay = callgraph.layers(spark, e).groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_types"), F.count_if(F.col("component_size") > 1).alias("n_on_cycles"))
    return lay.join(e.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_edges")), RUN).select(*RUN, "n_types", "n_edges", "n_on_cycles", (F.col("n_on_cycles") > 0).alias("has_cycle"))


_PEELED = f"""WITH RECURSIVE {core._E.replace("e AS (SELECT DISTINCT", "e_ AS (SELECT DISTINCT").replace("FROM e LEFT JOIN", "FROM e_ e LEFT JOIN")}, e AS (SELECT * FROM inn), {_LAYERED},
  cyc AS (SELECT DISTINCT project, run_id, node FROM c WHERE size > 1 UNION SELECT DISTINCT r.project, r.run_id, r.src FROM r JOIN c ON c.project = r.project AND c.run_id = r.run_id AND c.node = r.dst WHERE c.size > 1),
  own AS (SELECT l.project, l.run_id, l.node, l.layer FROM lay l LEFT JOIN cyc USING (project, run_id, node) WHERE cyc.node IS NULL)
  SELECT project, run_id, node, CAST(layer AS INTEGER) AS peel_round FROM own UNION ALL SELECT y.project, y.run_id, y.node, CAST(coalesce((SELECT max(layer) + 1 FROM own o WHERE o.project = y.project AND o.run_id = y.run_id), 0) AS INTEGER) FROM cyc y"""
SQL["peel_layers"] = _PEELED


def _batch_groups(size: int, seed: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        listed = lambda v: [] if v is None else list(v)
        items = [(k, [x["key"] for x in sorted(listed(n), key=lambda x: (x["tier"], x["key"]))], set(listed(r))) for k, n, r in zip(pdf["node"], pdf["near"], pdf["kin"])]
        rows = [(pdf["project"].iloc[0], pdf["run_id"].iloc[0], no, at, k) for no, b in enumerate(callgraph.batches(items, size, seed), 1) for at, k in enumerate(b, 1)]
        return pd.DataFrame(rows, columns=["project", "run_id", "batch_no", "position", "header_key"])

    return run


@query()
def header_batches(spark, sf, size: int = 5, seed: int | None = None):
    """Greedy batches of each run's headers in the order of their translated includes: relatives by inheritance, includes, imports and forward declarations first.

    Every choice depends on those before it, so one run's headers form one group; it holds keys only, no texts.
    """
    h = load(spark, sf, "headers", *RUN, "header_key", "header_id", "include_dependencies", "imports", "raw_translated_code").where("header_key is not null")
    deps = F.transform("include_dependencies", lambda x: F.regexp_replace(x, r"\.(h|hpp)$", ""))
    order = callgraph.dependency_order(spark, load(spark, sf, "headers", *RUN, "header_key", "include_dependencies", "ord"), F.translate("header_key", "$", "_"), deps, "ord").select(*RUN, "node", "position")
    key = F.translate("header_key", "$", "_")
    kin = core.inheritance_edges(spark, sf).select(*RUN, F.translate("child", "$", "_").alias("a"), F.translate("parent", "$", "_").alias("b"))
    kin = kin.union(kin.select(*RUN, "b", "a")).where("a <> b").distinct()
    named = lambda c, tier: h.select(*RUN, key.alias("a"), F.explode(c).alias("b"), F.lit(tier).alias("tier"))
    forward = F.regexp_extract_all("raw_translated_code", F.lit(r"(?m)^\s*(?:class|struct)\s+([A-Za-z_]\w*)\s*;"), F.lit(1))
    near = kin.withColumn("tier", F.lit(0)).union(named(deps, 1)).union(named(F.transform("imports", lambda x: F.regexp_extract(x, r"([^.]*)$", 1)), 2)).union(named(forward, 3))
    near = near.where("a <> b").join(order.select(*RUN, F.col("node").alias("b")), [*RUN, "b"], "left_semi").groupBy(*RUN, "a", "b").agg(F.min("tier").alias("tier"))
    near = near.groupBy(*RUN, F.col("a").alias("node")).agg(F.collect_list(F.struct("tier", F.col("b").alias("key"))).alias("near"))
    kin = kin.groupBy(*RUN, F.col("a").alias("node")).agg(F.collect_set("b").alias("kin"))
    x = order.join(near, [*RUN, "node"], "left").join(kin, [*RUN, "node"], "left")
    return x.groupBy(*RUN).applyInPandas(_batch_groups(size, seed), "project string, run_id string, batch_no int, position int, header_key string")


@query()
def import_cycles(spark, sf):
    """Cycles of each run's import graph that a depth-first search closes, in canonical form. Only edges inside a component can, and each component is a group of its own."""
    e = Stage(spark, "imports").put(core.import_edges(spark, sf).select(*RUN, F.col("header_key").alias("src"), F.col("target").alias("dst")).distinct())
    return callgraph.component_cycles(spark, e)


# ------------------------------------------------------------------ states, routing, patches
_FIRST_HEADER = "fh AS (SELECT project, run_id, header_key, arg_min(raw_translated_code, header_id) FILTER (raw_translated_code IS NOT NULL) AS target FROM headers WHERE header_key IS NOT NULL GROUP BY ALL)"


def first_targets(spark, sf):
    """The first translation of each header."""
    h = load(spark, sf, "headers", *RUN, "header_key", "header_id", "raw_translated_code").where("header_key is not null")
    return h.groupBy(*RUN, "header_key").agg(F.min_by("raw_translated_code", F.when(F.col("raw_translated_code").isNotNull(), F.col("header_id"))).alias("target"))


@query(f"""WITH {_FIRST_HEADER}, m AS (SELECT m.method_id, coalesce(method_body_location, '') AS loc, coalesce(mapping_status = 'already_implemented', false) AS done, regexp_matches(coalesce(trim(m.raw_translated_code), ''), '=\\s*(default|delete)\\s*;?\\s*$') AS dropped, starts_with(coalesce(ltrim(m.raw_translated_code), ''), 'template') AS tmpl, coalesce(contains(fh.target, 'template <'), false) AS up FROM methods m LEFT JOIN fh USING (project, run_id, header_key))
  SELECT method_id, NOT done AND (loc = 'header' OR (loc NOT IN ('header', 'cpp', 'none') AND (up OR tmpl))) AS in_header, loc = 'cpp' OR (loc NOT IN ('header', 'cpp', 'none') AND NOT (up OR tmpl) AND NOT done AND NOT dropped) AS in_cpp FROM m""")
def emit_routing(spark, sf):
    """Whether a method's code goes into the header or into the implementation file."""
    m = load(spark, sf, "methods", "method_id", *RUN, "header_key", "mapping_status", "method_body_location", "raw_translated_code").join(first_targets(spark, sf), [*RUN, "header_key"], "left")
    code = F.coalesce("raw_translated_code", F.lit(""))
    to = mapping.routing(F.col("method_body_location"), F.col("mapping_status") == "already_implemented", F.trim(code).rlike(r"=\s*(?:default|delete)\s*;?\s*$"), F.ltrim(code).startswith("template"), F.col("target").contains("template <"))
    return m.select("method_id", to.alias("to")).select("method_id", "to.*")


@query("""WITH m AS (SELECT method_id, mapping_status AS s, method_body_location AS loc, trim(coalesce(raw_translated_code, '')) AS d, coalesce(mapping_status = 'already_implemented', false) AS done, starts_with(ltrim(coalesce(raw_translated_code, '')), 'template') AS tmpl, nullif(trim(skip_translation_reason), '') AS why FROM methods WHERE coalesce(mapping_status, '') <> '' OR coalesce(method_body_location, '') <> ''),
  k AS (SELECT *, CASE WHEN d = '' THEN 1 WHEN done THEN 2 WHEN regexp_matches(d, '=\\s*0\\s*;?\\s*$') THEN 3 WHEN regexp_matches(d, '=\\s*(default|delete)\\s*;?\\s*$') THEN 4 WHEN s IN ('invalid_cpp_definition', 'unmapped') THEN 5 ELSE 6 END AS k, CASE WHEN loc IN ('header', 'cpp') THEN loc WHEN tmpl THEN 'header' ELSE 'cpp' END AS place FROM m)
  SELECT method_id, CASE k WHEN 1 THEN coalesce(nullif(s, ''), 'deleted_or_merged') WHEN 2 THEN 'already_implemented' WHEN 3 THEN 'pure_virtual' WHEN 4 THEN 'defaulted_or_deleted' WHEN 5 THEN s ELSE 'needs_' || place || '_body' END AS mapping_status, CASE WHEN k < 6 THEN 'none' ELSE place END AS body_location, k < 6 AS skip,
    CASE k WHEN 1 THEN coalesce(why, 'deleted_or_merged') WHEN 2 THEN 'already_implemented' WHEN 3 THEN 'pure_virtual' WHEN 4 THEN 'defaulted_or_deleted' WHEN 5 THEN coalesce(why, s) ELSE '' END AS reason FROM k""")
def mapped_states(spark, sf):
    """The state that its mapping gives each mapped method."""
    m = load(spark, sf, "methods", "method_id", "mapping_status", "method_body_location", "raw_translated_code", "skip_translation_reason").where("coalesce(mapping_status, '') <> '' or coalesce(method_body_location, '') <> ''")
    done = F.col("mapping_status") == "already_implemented"
    why = F.when(F.trim("skip_translation_reason") != "", F.trim("skip_translation_reason"))
    s = mapping.mapped_state(F.col("mapping_status"), F.col("method_body_location"), F.col("raw_translated_code"), done, done, F.ltrim(F.coalesce("raw_translated_code", F.lit(""))).startswith("template"), why)
    return m.select("method_id", s.alias("s")).select("method_id", "s.*")


_SHORT = "regexp_extract(m.header_key, '([^$.]*)$', 1)"


@query(f"""WITH {_FIRST_HEADER}, m AS (SELECT m.method_id, trim(coalesce(m.raw_translated_code, '')) AS d, coalesce(regexp_matches(fh.target, '\\b(?:class|struct)\\s+' || {_SHORT} || '\\b[^;{{]*\\{{'), false) AS owned, coalesce(contains(fh.target, {_SHORT} || '::' || regexp_extract(m.method_key, ':([^(]*)', 1) || '('), false) AS inside, coalesce(contains(fh.target, regexp_extract(m.method_key, ':([^(]*)', 1)), false) AS named FROM methods m LEFT JOIN fh USING (project, run_id, header_key) WHERE m.method_key IS NOT NULL)
  SELECT method_id, owned AND regexp_matches(d, '=\\s*delete\\s*;?\\s*$') AS deleted, CASE WHEN NOT owned THEN 'owner_not_defined' WHEN regexp_matches(d, '=\\s*delete\\s*;?\\s*$') THEN 'deleted' WHEN regexp_matches(d, '=\\s*0\\s*;?\\s*$') THEN 'pure_virtual' WHEN regexp_matches(d, '=\\s*default\\s*;?\\s*$') THEN 'defaulted' WHEN contains(d, '{{') THEN 'declaration_has_body' WHEN inside THEN 'defined_in_header' WHEN d = '' AND NOT named THEN 'not_declared' ELSE '' END AS reason FROM m""")
def declared_states(spark, sf):
    """The state that the translated header gives each method, as if it had no mapping."""
    m = load(spark, sf, "methods", "method_id", *RUN, "header_key", "method_key", "raw_translated_code").where("method_key is not null").join(first_targets(spark, sf), [*RUN, "header_key"], "left")
    short, name = F.regexp_extract("header_key", r"([^$.]*)$", 1), F.regexp_extract("method_key", r":([^(]*)", 1)
    owned = F.regexp_like("target", F.concat(F.lit(r"\b(?:class|struct)\s+"), short, F.lit(r"\b[^;{]*\{")))
    s = mapping.declared_state(F.col("raw_translated_code"), owned, F.contains("target", F.concat(short, F.lit("::"), name, F.lit("("))), F.contains("target", name))
    return m.select("method_id", s.alias("s")).select("method_id", "s.deleted", "s.reason")


_MISSING = "SELECT DISTINCT project, run_id, regexp_replace(regexp_extract(line, 'fatal error: ''([^'']+)'' file not found', 1), '\\.(h|hpp)$', '') AS class_name FROM (SELECT project, run_id, unnest(string_split(log_output, chr(10))) AS line FROM compile_result) l WHERE regexp_matches(line, 'fatal error: ''([^'']+)'' file not found')"


@query(f"SELECT p.project, p.run_id, p.class_name, CASE WHEN EXISTS (SELECT 1 FROM headers h WHERE h.project = p.project AND h.run_id = p.run_id AND h.translated_class_name = p.class_name) THEN 'exists' ELSE 'added' END AS outcome FROM ({_MISSING}) p")
def inserted_headers(spark, sf):
    """A header is added for every include that a run's compiler did not find, unless the run has one."""
    lines = load(spark, sf, "compile_result", *RUN, "log_output").select(*RUN, F.explode(F.split("log_output", "\n")).alias("line")).where("line rlike \"fatal error: '([^']+)' file not found\"")
    p = lines.select(*RUN, F.regexp_replace(text.missing_include(F.col("line")), r"\.(h|hpp)$", "").alias("class_name")).distinct().withColumn("source_code", F.concat(F.lit("#pragma once\nclass "), "class_name", F.lit(";\n")))
    h = load(spark, sf, "headers", *RUN, F.col("translated_class_name").alias("class_name"), "source_kind", "source_code")
    return mapping.insert_absent(h, p, [*RUN, "class_name"], "source_code")[1]


@query("""SELECT f.project, f.run_id, f.round, count(*) AS n_outputs, count(*) FILTER (h.header_key IS NULL) AS n_unexpected, CASE WHEN count(*) FILTER (h.header_key IS NULL) > 0 THEN 'rolled_back' ELSE 'kept' END AS outcome
  FROM compile_feedback f LEFT JOIN (SELECT DISTINCT project, run_id, header_key FROM headers WHERE source_kind = 'java') h ON h.project = f.project AND h.run_id = f.run_id AND h.header_key = f.header_key GROUP BY f.project, f.run_id, f.round""")
def batch_rollback(spark, sf):
    """Rounds that put out a header nobody asked for are rolled back whole."""
    f = load(spark, sf, "compile_feedback", *RUN, "header_key", "round")
    return mapping.accepted_batches(f, load(spark, sf, "headers", *RUN, "header_key", "source_kind").where("source_kind = 'java'"), RUN, "round", "header_key")


# ------------------------------------------------------------------ nested records
@query("""WITH h AS (SELECT project, run_id, header_key, min(ai) AS ai FROM headers WHERE header_key IS NOT NULL GROUP BY ALL),
  i AS (SELECT project, run_id, header_key, string_agg(DISTINCT inc, ';' ORDER BY inc) AS includes FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) x WHERE inc IS NOT NULL GROUP BY ALL),
  f AS (SELECT project, run_id, header_key, string_agg(DISTINCT method_key, ';' ORDER BY method_key) AS functions, count(DISTINCT method_key) AS n_functions FROM methods WHERE method_key IS NOT NULL GROUP BY ALL)
  SELECT h.project, h.run_id, h.header_key, h.ai, replace(h.header_key, '$', '_') || '.h' AS file_name, coalesce(i.includes, '') AS includes, coalesce(f.functions, '') AS functions, coalesce(f.n_functions, 0) AS n_functions FROM h LEFT JOIN i USING (project, run_id, header_key) LEFT JOIN f USING (project, run_id, header_key)""")
def eval_records(spark, sf):
    """One nested record per header (its includes and functions as lists), here with the lists joined."""
    r = contexts.eval_records(load(spark, sf, "headers", *RUN, "ai", "header_key", "include_dependencies"), load(spark, sf, "methods", *RUN, "header_key", "method_key", "code"))
    return r.select(*RUN, "header_key", "ai", "file_name", F.array_join("includes", ";").alias("includes"), F.array_join("functions.signature", ";").alias("functions"), F.size("functions").cast("long").alias("n_functions"))


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY round DESC NULLS LAST, feedback_id DESC) AS rn FROM compile_feedback) x WHERE rn = 1 AND NOT coalesce(success, false))
  SELECT project, run_id, header_key, round, coalesce(has_local_issues, false) AS has_local_issues, coalesce(blocked_by_dependency, false) AS blocked_by_dependency, CAST(coalesce(len(list_filter(diagnostic_blocks, lambda b: b <> '')), 0) AS BIGINT) AS n_blocks, coalesce(left(regexp_replace(list_filter(diagnostic_blocks, lambda b: b <> '')[1], '\\s+', ' ', 'g'), 240), '') AS first_detail FROM l""")
def failure_summaries(spark, sf):
    """The last report of each header that failed in it, its issues as a list, here counted."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "success", "has_local_issues", "blocked_by_dependency", "diagnostic_blocks")
    s = contexts.failure_summaries(f)
    return s.select(*RUN, "header_key", "round", "has_local_issues", "blocked_by_dependency", F.size("details").cast("long").alias("n_blocks"), F.coalesce(F.get("details", F.lit(0)), F.lit("")).alias("first_detail"))


_OUT = "replace(header_key, '$', '_') || '.h'"


@query(f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY round DESC NULLS LAST, feedback_id DESC) AS rn FROM compile_feedback) x WHERE rn = 1 AND NOT coalesce(success, false)),
  b AS (SELECT project, run_id, header_key, unnest(diagnostic_blocks) AS block, generate_subscripts(diagnostic_blocks, 1) AS pos FROM last),
  named AS (SELECT project, run_id, header_key, regexp_extract(block, '(?:^|\\n)\\s*(?:[^\\s:/]*/)*([^\\s:/]+\\.(?:h|hpp)):\\d+:\\d+: (?:fatal )?error:', 1) AS file, pos FROM b),
  outs AS (SELECT DISTINCT project, run_id, header_key AS other, {_OUT} AS file FROM headers WHERE header_key IS NOT NULL AND trim(coalesce(raw_translated_code, '')) <> ''),
  inc AS (SELECT DISTINCT project, run_id, header_key, inc AS file FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS inc FROM headers) y WHERE inc IS NOT NULL),
  cand AS (SELECT n.project, n.run_id, n.header_key, o.other, 0 AS tier, n.pos FROM named n JOIN outs o USING (project, run_id, file) UNION ALL SELECT l.project, l.run_id, l.header_key, o.other, 1, 0 FROM last l JOIN inc i USING (project, run_id, header_key) JOIN outs o ON o.project = i.project AND o.run_id = i.run_id AND o.file = i.file),
  best AS (SELECT project, run_id, header_key, other, min((tier, pos)) AS rank FROM cand WHERE other <> header_key GROUP BY ALL)
  SELECT project, run_id, header_key, other, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY rank, other) AS rn FROM best) z WHERE rn <= 4""")
def repair_context(spark, sf):
    """Up to four other headers for repairing one that failed last: those that its errors point at, then its includes."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "success", "diagnostic_blocks")
    return contexts.repair_context(f, load(spark, sf, "headers", *RUN, "header_key", "include_dependencies", "raw_translated_code"), 4)


@query(f"""WITH outs AS (SELECT DISTINCT project, run_id, header_key AS other, {_OUT} AS file FROM headers WHERE header_key IS NOT NULL AND trim(coalesce(raw_translated_code, '')) <> ''),
  inc AS (SELECT DISTINCT i.project, i.run_id, i.header_key, o.other FROM (SELECT project, run_id, header_key, unnest(include_dependencies) AS file FROM headers) i JOIN outs o USING (project, run_id, file)),
  m AS (SELECT project, run_id, method_key, min(header_key) AS header_key FROM methods WHERE method_key IS NOT NULL AND header_key IS NOT NULL GROUP BY ALL),
  {core._E}, callee AS (SELECT DISTINCT a.project, a.run_id, a.method_key, b.header_key AS ch FROM inn e2 JOIN m a ON a.project = e2.project AND a.run_id = e2.run_id AND a.method_key = e2.src JOIN m b ON b.project = e2.project AND b.run_id = e2.run_id AND b.method_key = e2.dst),
  cand AS (SELECT m.project, m.run_id, m.method_key, i.other, 0 AS tier FROM m JOIN inc i USING (project, run_id, header_key)
    UNION ALL SELECT c.project, c.run_id, c.method_key, o.other, 1 FROM callee c JOIN outs o ON o.project = c.project AND o.run_id = c.run_id AND o.other = c.ch
    UNION ALL SELECT c.project, c.run_id, c.method_key, i.other, 2 FROM callee c JOIN inc i ON i.project = c.project AND i.run_id = c.run_id AND i.header_key = c.ch),
  best AS (SELECT cand.project, cand.run_id, cand.method_key, cand.other, min(tier) AS tier FROM cand JOIN m USING (project, run_id, method_key) WHERE cand.other <> m.header_key GROUP BY ALL)
  SELECT project, run_id, method_key, other, tier, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, method_key ORDER BY tier, other) AS rn FROM best) z WHERE rn <= 4""")
def method_context(spark, sf):
    """Up to four headers for translating a method: its own includes, then its callees' headers, then their includes."""
    h = load(spark, sf, "headers", *RUN, "header_key", "include_dependencies", "raw_translated_code")
    return contexts.method_context(h, load(spark, sf, "methods", *RUN, "method_key", "header_key"), core.inner(spark, sf), 4)


# ------------------------------------------------------------------ evaluation rows
_STUBBED = "SELECT project, run_id, bool_or(source_kind IN ('generated_external', 'manual_stub')) AS stubs FROM headers GROUP BY ALL"
_EVALUATED = f"""SELECT r.project, r.run_id, coalesce(round(count(*) FILTER (kind = 'header' AND ok) / nullif(count(*) FILTER (kind = 'header'), 0)::DOUBLE, 6), 1.0) AS header_rate, coalesce(round(count(*) FILTER (kind = 'cpp' AND ok) / nullif(count(*) FILTER (kind = 'cpp'), 0)::DOUBLE, 6), 1.0) AS cpp_rate, bool_and(kind <> 'cpp' OR ok) AS operational_link, bool_and(kind <> 'cpp' OR ok) AND NOT coalesce(any_value(s.stubs), false) AS strict_link
  FROM (SELECT *, coalesce(success, false) AS ok FROM compile_result) r LEFT JOIN ({_STUBBED}) s USING (project, run_id) GROUP BY r.project, r.run_id"""


def evaluation(spark, sf):
    r = load(spark, sf, "compile_result", *RUN, "kind", "success").withColumn("ok", metrics.as_flag(F.col("success"), False))
    stubs = load(spark, sf, "headers", *RUN, "source_kind").groupBy(*RUN).agg(F.bool_or(F.col("source_kind").isin("generated_external", "manual_stub")).alias("stubs"))
    rate = lambda k: F.coalesce(F.round(F.try_divide(F.count_if((F.col("kind") == k) & F.col("ok")), F.count_if(F.col("kind") == k)), 6), F.lit(1.0))
    e = r.groupBy(*RUN).agg(rate("header").alias("header_rate"), rate("cpp").alias("cpp_rate"), F.bool_and((F.col("kind") != "cpp") | F.col("ok")).alias("operational_link"), F.count_if(F.col("kind") == "header").alias("header_count"), F.count_if((F.col("kind") == "header") & F.col("ok")).alias("header_success"), F.count_if(F.col("kind") == "cpp").alias("cpp_count"), F.count_if((F.col("kind") == "cpp") & F.col("ok")).alias("cpp_success"))
    return e.join(stubs, RUN, "left").withColumn("strict_link", F.col("operational_link") & ~F.coalesce("stubs", F.lit(False)))


@query(_EVALUATED)
def project_evaluation(spark, sf):
    """Rates by kind and whether a run links: with its stubs, and without any."""
    return evaluation(spark, sf).select(*RUN, "header_rate", "cpp_rate", "operational_link", "strict_link")


@query("SELECT project, run_id, count(*) FILTER (kind = 'cpp') AS n_sources, coalesce(bool_and(coalesce(success, false)) FILTER (kind = 'cpp'), true) AS linked, coalesce(bool_and(coalesce(success, false)) FILTER (kind = 'cpp'), true) AND coalesce(bool_and(coalesce(success, false)) FILTER (kind = 'header'), true) AS gate FROM compile_result GROUP BY ALL")
def link_gate(spark, sf):
    """A run without sources links; it passes the gate if its headers hold as well."""
    r = load(spark, sf, "compile_result", *RUN, "kind", "success").withColumn("ok", metrics.as_flag(F.col("success"), False))
    every = lambda k: F.coalesce(F.bool_and(F.when(F.col("kind") == k, F.col("ok"))), F.lit(True))
    return r.groupBy(*RUN).agg(F.count_if(F.col("kind") == "cpp").alias("n_sources"), every("cpp").alias("linked"), (every("cpp") & every("header")).alias("gate"))


_EXPERIMENT = """WITH h AS (SELECT project, run_id, header_key, min(ai) AS ai, bool_or(source_kind = 'generated_external') AS gen, arg_max(coalesce(latest_compile_status, '') = 'success', header_id) AS ok FROM headers WHERE header_key IS NOT NULL GROUP BY ALL),
  r AS (SELECT project, run_id, count(DISTINCT round) AS rounds_used FROM compile_feedback GROUP BY ALL)
  SELECT h.project, h.run_id, min(h.ai) AS ai, any_value(r.rounds_used) AS rounds_used, bool_and(ok) AS converged, count(*) FILTER (NOT gen AND ok) AS source_success, count(*) FILTER (NOT gen) AS source_total, count(*) FILTER (gen AND ok) AS generated_success, count(*) FILTER (gen) AS generated_total, count(*) FILTER (ok) AS all_success, count(*) AS all_total, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS all_success_rate, round(count(*) FILTER (NOT gen AND ok) / nullif(count(*) FILTER (NOT gen), 0)::DOUBLE, 6) AS source_success_rate, coalesce(string_agg(CASE WHEN NOT gen AND NOT ok THEN header_key END, ';' ORDER BY header_key), '') AS failed_source_headers
  FROM h LEFT JOIN r USING (project, run_id) GROUP BY h.project, h.run_id"""


@query(_EXPERIMENT)
def experiment_rows(spark, sf):
    """One row a run: headers that compile among sources and generated ones, convergence, rounds, names of failures."""
    h = load(spark, sf, "headers", *RUN, "header_key", "header_id", "ai", "source_kind", "latest_compile_status").where("header_key is not null")
    h = h.groupBy(*RUN, "header_key").agg(F.min("ai").alias("ai"), F.bool_or(F.col("source_kind") == "generated_external").alias("gen"), F.max_by(F.coalesce("latest_compile_status", F.lit("")) == "success", "header_id").alias("ok"))
    rounds = load(spark, sf, "compile_feedback", *RUN, "round").groupBy(*RUN).agg(F.countDistinct("round").alias("rounds_used"))
    gen, ok, one = F.col("gen"), F.col("ok"), F.count(F.lit(1))
    x = h.groupBy(*RUN).agg(F.min("ai").alias("ai"), F.bool_and("ok").alias("converged"), F.count_if(~gen & ok).alias("source_success"), F.count_if(~gen).alias("source_total"), F.count_if(gen & ok).alias("generated_success"), F.count_if(gen).alias("generated_total"), F.count_if(ok).alias("all_success"), one.alias("all_total"), F.round(F.count_if(ok) / one, 6).alias("all_success_rate"), F.round(F.try_divide(F.count_if(~gen & ok), F.count_if(~gen)), 6).alias("source_success_rate"), F.array_join(F.sort_array(F.collect_list(F.when(~gen & ~ok, F.col("header_key")))), ";").alias("failed_source_headers"))
    return x.join(rounds, RUN, "left")


@query("""WITH m AS (SELECT project, run_id, count(*) AS method_count, count(*) FILTER (mapping_status = 'already_implemented') AS method_success, sum(len(string_split(coalesce(code, ''), chr(10)))) AS method_loc FROM methods GROUP BY ALL), c AS (SELECT project, run_id, count(*) FILTER (kind = 'header') AS header_count, count(*) FILTER (kind = 'header' AND coalesce(success, false)) AS header_success, count(*) FILTER (kind = 'cpp') AS cpp_count, count(*) FILTER (kind = 'cpp' AND coalesce(success, false)) AS cpp_success FROM compile_result GROUP BY ALL)
  SELECT c.*, m.method_count, m.method_success, CAST(m.method_loc AS BIGINT) AS method_loc, round(m.method_success / m.method_count::DOUBLE, 6) AS method_rate FROM c JOIN m USING (project, run_id)""")
def summary_fields(spark, sf):
    """A run's evaluation flattened to one row."""
    m = load(spark, sf, "methods", *RUN, "mapping_status", "code").groupBy(*RUN).agg(F.count(F.lit(1)).alias("method_count"), F.count_if(F.col("mapping_status") == "already_implemented").alias("method_success"), F.sum(F.size(F.split(F.coalesce("code", F.lit("")), "\n"))).alias("method_loc"))
    nested = evaluation(spark, sf).select(*RUN, F.struct("header_count", "header_success", "cpp_count", "cpp_success").alias("files")).join(m, RUN).select(*RUN, "files", F.struct("method_count", "method_success", "method_loc", F.round(F.col("method_success") / F.col("method_count"), 6).alias("method_rate")).alias("coarse"))
    return nested.select(*RUN, "files.*", "coarse.*")


@query("""WITH a AS (SELECT project, run_id, header_key, row_number() OVER (PARTITION BY project, run_id, header_key ORDER BY round, feedback_id) AS k, coalesce(success, false) AS ok FROM compile_feedback WHERE round IS NOT NULL AND header_key IS NOT NULL), f AS (SELECT project, run_id, header_key, count(*) AS queries, bool_or(ok AND k = 1) AS at_1, bool_or(ok AND k <= 5) AS at_budget, bool_or(ok) AS solved FROM a GROUP BY ALL)
  SELECT project, run_id, count(*) AS fragment_count, 5 AS fragment_budget, round(count(*) FILTER (at_1) / count(*)::DOUBLE, 6) AS compile_at_1, round(count(*) FILTER (at_budget) / count(*)::DOUBLE, 6) AS compile_at_budget, round(count(*) FILTER (NOT solved) / count(*)::DOUBLE, 6) AS stub_rate, round(avg(queries), 6) AS average_queries, CAST(sum(queries) AS BIGINT) AS total_queries FROM f GROUP BY project, run_id""")
def fragment_fields(spark, sf, budget: int = 5):
    """Rates of fragments solved at the first try and within the budget; the budget is a column, so names stay fixed."""
    f = load(spark, sf, "compile_feedback", "feedback_id", *RUN, "header_key", "round", "success").where("round is not null and header_key is not null")
    k = F.row_number().over(Window.partitionBy(*RUN, "header_key").orderBy("round", "feedback_id"))
    ok = metrics.as_flag(F.col("success"), False)
    x = f.withColumn("k", k).groupBy(*RUN, "header_key").agg(F.count(F.lit(1)).alias("queries"), F.bool_or(ok & (F.col("k") == 1)).alias("at_1"), F.bool_or(ok & (F.col("k") <= budget)).alias("at_budget"), F.bool_or(ok).alias("solved"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    return x.groupBy(*RUN).agg(F.count(F.lit(1)).alias("fragment_count"), F.lit(budget).alias("fragment_budget"), share(F.col("at_1")).alias("compile_at_1"), share(F.col("at_budget")).alias("compile_at_budget"), share(~F.col("solved")).alias("stub_rate"), F.round(F.avg("queries"), 6).alias("average_queries"), F.sum("queries").alias("total_queries"))


@query("""SELECT project, file_name, arg_min(success, result_id) FILTER (ai = 'deepseek-v3') AS model_1, count(DISTINCT ai) AS n_models, arg_min(ai, result_id) AS first_model, arg_min(coalesce(success, false), result_id) AS first_ok FROM compile_result WHERE file_name IS NOT NULL GROUP BY ALL""".replace("arg_min(success, result_id) FILTER (ai = 'deepseek-v3') AS model_1, ", ""))
def file_first(spark, sf):
    """The first recorded outcome of each file over all models; first by result, so that it is the same on every run."""
    r = load(spark, sf, "compile_result", "result_id", "project", "ai", "file_name", "success").where("file_name is not null")
    return r.groupBy("project", "file_name").agg(F.countDistinct("ai").alias("n_models"), F.min_by("ai", "result_id").alias("first_model"), F.min_by(metrics.as_flag(F.col("success"), False), "result_id").alias("first_ok"))


@query("""SELECT project, round(avg(CASE WHEN kind = 'header' THEN CAST(coalesce(success, false) AS INTEGER) END), 6) AS header_rate, round(avg(CASE WHEN kind = 'cpp' THEN CAST(coalesce(success, false) AS INTEGER) END), 6) AS cpp_rate, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, project) AS position FROM compile_result WHERE project IS NOT NULL GROUP BY project""")
def rate_by_size(spark, sf):
    """Rates of each project by kind, the largest project first."""
    r = load(spark, sf, "compile_result", "project", "kind", "success").where("project is not null").withColumn("ok", metrics.as_flag(F.col("success"), False).cast("int"))
    p = r.groupBy("project").agg(*[F.round(F.avg(F.when(F.col("kind") == k, F.col("ok"))), 6).alias(f"{k}_rate") for k in ("header", "cpp")], F.count(F.lit(1)).alias("size"))
    return p.withColumn("position", F.row_number().over(Window.orderBy(F.desc("size"), "project")).cast("long"))  # over the few projects


@query("SELECT stage, kind, n, row_number() OVER (ORDER BY CASE stage WHEN 'pre' THEN 1 WHEN 'post' THEN 2 ELSE 3 END, CASE kind WHEN 'cpp' THEN 1 WHEN 'header' THEN 2 ELSE 3 END, stage, kind) AS position FROM (SELECT stage, kind, count(*) AS n FROM compile_result GROUP BY ALL) x")
def dimension_order(spark, sf):
    """Groups in the order of two given lists, what they do not name last."""
    n = load(spark, sf, "compile_result", "stage", "kind").groupBy("stage", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("position", F.row_number().over(Window.orderBy(*metrics.list_order({"stage": ["pre", "post"], "kind": ["cpp", "header"]}), "stage", "kind")).cast("long"))  # over the few groups


@query("""SELECT doc_id, CASE WHEN json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END, '$.tool_results') = 'ARRAY' THEN right(text, 300) ELSE left(text, 300) || chr(10) || '...[truncated early interaction]' END AS kept FROM documents WHERE length(text) > 300""")
def old_turns(spark, sf):
    """Early turns of a conversation shortened: tool results keep their tail, other texts their head."""
    d = load(spark, sf, "documents", "doc_id", "text").where("length(text) > 300")
    return d.select("doc_id", contexts.old_turn(F.col("text"), 300).alias("kept"))


@query("""WITH a AS (SELECT project, run_id, header_key, count(*) AS turns, bool_or(coalesce(success, false)) AS solved, min(CASE WHEN coalesce(success, false) THEN round END) AS solved_at FROM compile_feedback WHERE round IS NOT NULL AND header_key IS NOT NULL GROUP BY ALL)
  SELECT project, run_id, count(*) AS n_files, count(*) FILTER (solved) AS n_solved, CAST(sum(least(turns, 10)) AS BIGINT) AS n_attempts, count(*) FILTER (NOT solved AND turns >= 3) AS n_at_limit FROM a GROUP BY project, run_id""")
def repair_loops(spark, sf, limit: int = 3, tries: int = 10):
    """Repair of each run's files from recorded turns: how many were solved, how many ended at the limit."""
    f = load(spark, sf, "compile_feedback", *RUN, "header_key", "round", "success").where("round is not null and header_key is not null")
    a = f.groupBy(*RUN, "header_key").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(metrics.as_flag(F.col("success"), False)).alias("solved"))
    return a.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("solved")).alias("n_solved"), F.sum(F.least("turns", F.lit(tries))).alias("n_attempts"), F.count_if(~F.col("solved") & (F.col("turns") >= limit)).alias("n_at_limit"))


# ------------------------------------------------------------------ relatives by spelling
def _spellings(c: str) -> str:
    for _ in range(6):
        c = f"regexp_replace({c}, '<[^<>]*>', '', 'g')"
    c = f"trim({c})"
    parts = [c, f"regexp_extract({c}, '([^.]*)$', 1)", f"string_split({c}, '::')[-1]", f"regexp_extract({c}, '([^$]*)$', 1)", f"replace({c}, '$', '::')", f"regexp_extract({c}, '([^.$:]*)$', 1)"]
    return f"list_filter([{', '.join(parts)}], lambda v: v <> '')"


@query(f"""WITH k AS (SELECT DISTINCT project, run_id, header_key, unnest({_spellings("header_key")}) AS nm FROM headers WHERE header_key IS NOT NULL),
  r AS (SELECT DISTINCT project, run_id, header_key, unnest({_spellings("raw")}) AS nm FROM (SELECT project, run_id, header_key, parent_class AS raw FROM headers UNION ALL SELECT project, run_id, header_key, unnest(interfaces) FROM headers) x WHERE raw IS NOT NULL AND header_key IS NOT NULL)
  SELECT DISTINCT r.project, r.run_id, r.header_key AS child, k.header_key AS parent FROM r JOIN k USING (project, run_id, nm) WHERE r.header_key <> k.header_key""")
def kin_by_spelling(spark, sf):
    """Headers that a parent's or interface's name fits in any spelling: whole, without packages, outer classes or type arguments."""
    h = load(spark, sf, "headers", *RUN, "header_key", "parent_class", "interfaces").where("header_key is not null")
    k = h.select(*RUN, F.col("header_key").alias("parent"), F.explode(text.name_candidates(F.col("header_key"))).alias("nm")).distinct()
    raw = h.select(*RUN, F.col("header_key").alias("child"), F.explode(F.array_append(F.coalesce("interfaces", F.array().cast("array<string>")), F.col("parent_class"))).alias("raw")).where("raw is not null")
    r = raw.select(*RUN, "child", F.explode(text.name_candidates(F.col("raw"))).alias("nm")).distinct()
    return r.join(k, [*RUN, "nm"]).where("child <> parent").select(*RUN, "child", "parent").distinct()
