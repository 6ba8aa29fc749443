"""The named queries of the core: what __spark_entry__ offers."""

from __future__ import annotations

from ..operators import hierarchy, logparse
from . import code_queries, core_queries, graph_queries, more_queries, report_queries, store_queries  # noqa: F401  these add to the tables of core_queries

QUERIES = {
    "p2_found": hierarchy.p2_found,
    "p2_hierarchies": hierarchy.p2_hierarchies,
    "p2_paths": hierarchy.p2_paths,
    "p7_found": logparse.p7_found,
    "p7_entries": logparse.p7_entries,
    "p7_templates": logparse.p7_templates,
} | core_queries.Q
def _type(c: str) -> str:
    """A type name's last part, in SQL."""
    for _ in range(5):
        c = f"regexp_replace({c}, '<[^<>]*>', '', 'g')"
    return f"nullif(regexp_extract(regexp_replace({c}, '@[A-Za-z_0-9.]+', ' ', 'g'), '([A-Za-z_0-9]+)\\s*$', 1), '')"


def _method(c: str) -> str:
    """A method key by the types it means, in SQL."""
    c = f"regexp_replace(regexp_replace({c}, '@[A-Za-z_0-9.]+', '', 'g'), '\\s+', '', 'g')"
    return f"nullif(regexp_replace({c}, '(?:[A-Za-z_0-9]+[.$])+([A-Za-z_])', '\\1', 'g'), '')"


_SAME = "{a}.project = {b}.project AND {a}.run_id = {b}.run_id"
P2_FOUND = f"""
  WITH RECURSIVE
  hn AS (SELECT project, run_id, header_key, min(header_id) AS id, {_type("header_key")} AS nm FROM headers WHERE header_key IS NOT NULL GROUP BY ALL),
  hr AS (SELECT project, run_id, header_key, parent_class AS raw FROM headers UNION SELECT project, run_id, header_key, unnest(interfaces) FROM headers),
  hp AS (SELECT project, run_id, header_key, {_type("raw")} AS nm FROM hr WHERE raw IS NOT NULL),
  hl AS (SELECT p.id AS a, c.id AS b FROM hp JOIN hn c ON {_SAME.format(a="c", b="hp")} AND c.header_key = hp.header_key JOIN hn p ON {_SAME.format(a="p", b="hp")} AND p.nm = hp.nm),
  mn AS (SELECT project, run_id, {_method("method_key")} AS k, min(method_id) AS id FROM methods WHERE method_key IS NOT NULL GROUP BY ALL),
  mr AS (SELECT project, run_id, method_key AS p, unnest(children) AS c FROM methods UNION SELECT project, run_id, unnest(parents), method_key FROM methods),
  mp AS (SELECT DISTINCT project, run_id, {_method("p")} AS p, {_method("c")} AS c FROM mr WHERE p IS NOT NULL AND c IS NOT NULL),
  ml AS (SELECT a.id AS a, b.id AS b FROM mp JOIN mn a ON {_SAME.format(a="a", b="mp")} AND a.k = mp.p JOIN mn b ON {_SAME.format(a="b", b="mp")} AND b.k = mp.c),
  e AS (SELECT DISTINCT 'class' AS kind, a, b FROM hl UNION SELECT 'call', a, b FROM ml),
  r AS (SELECT kind, a, b FROM e UNION SELECT r.kind, r.a, e.b FROM r JOIN e ON e.kind = r.kind AND e.a = r.b)
  SELECT DISTINCT kind AS link_kind, least(a, b) AS low_id, greatest(a, b) AS high_id FROM r"""
_CTES = P2_FOUND.rpartition("SELECT DISTINCT kind AS link_kind")[0].rstrip()
P2_PATHS = f"""{_CTES},
  n AS (SELECT 'class' AS kind, id FROM hn UNION ALL SELECT 'call', min(method_id) FROM methods WHERE method_key IS NOT NULL GROUP BY project, run_id, method_key),
  cyc AS (SELECT kind, a AS id FROM r WHERE a = b),
  below AS (SELECT kind, id FROM cyc UNION SELECT r.kind, r.b FROM r JOIN cyc ON cyc.kind = r.kind AND cyc.id = r.a),
  f AS (SELECT e.* FROM e LEFT JOIN below x ON x.kind = e.kind AND x.id = e.b WHERE x.id IS NULL),
  top AS (SELECT n.kind, n.id FROM n LEFT JOIN (SELECT DISTINCT kind, b FROM e) p ON p.kind = n.kind AND p.b = n.id WHERE p.b IS NULL),
  d AS (SELECT kind, id, 0 AS depth FROM top UNION SELECT f.kind, f.b, d.depth + 1 FROM d JOIN f ON f.kind = d.kind AND f.a = d.id),
  dm AS (SELECT kind, id, max(depth) AS depth FROM d GROUP BY ALL),
  via AS (SELECT kind, b AS id, a AS parent FROM (SELECT f.*, row_number() OVER (PARTITION BY f.kind, f.b ORDER BY dm.depth DESC, f.a) AS rn FROM f JOIN dm ON dm.kind = f.kind AND dm.id = f.a) x WHERE rn = 1),
  pth AS (SELECT kind, id, id AS root_id, CAST(id AS VARCHAR) AS path FROM top UNION ALL SELECT v.kind, v.id, p.root_id, p.path || '>' || v.id FROM pth p JOIN via v ON v.kind = p.kind AND v.parent = p.id),
  size AS (SELECT kind, a AS id, count(*) AS n FROM r GROUP BY ALL)
  SELECT n.kind AS link_kind, n.id AS node_id, CAST(dm.depth AS INTEGER) AS depth, pth.root_id, pth.path, coalesce(size.n, 0) AS n_descendants, cyc.id IS NOT NULL AS on_cycle
  FROM n LEFT JOIN dm ON dm.kind = n.kind AND dm.id = n.id LEFT JOIN pth ON pth.kind = n.kind AND pth.id = n.id LEFT JOIN size ON size.kind = n.kind AND size.id = n.id LEFT JOIN cyc ON cyc.kind = n.kind AND cyc.id = n.id"""
ORACLE: dict[str, str] = dict(core_queries.SQL) | {"p2_found": P2_FOUND, "p2_paths": P2_PATHS}
