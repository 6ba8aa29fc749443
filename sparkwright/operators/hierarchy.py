"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Bottom-up leaf peeling sends descendant lists and subtree sizes to the parents; the reverse peel order assigns
paths and depths; what no peeling removes holds the cycles, is closed over by itself and gets its paths first.

Two executions of the same method: graphs of a bounded number of links (``MAX_LINKS``) are peeled
inside one task each, larger ones by rounds of joins, so that no unbounded graph reaches one task. A task holds one
graph's descendants as bit sets, at most MAX_LINKS squared bits (50 MB), and hands on its rows in portions of
``PORTION`` list entries.

Null keys name no node, null, blank and unknown link names give no link, repeated links count once,
a node that links to itself lies on a cycle. Extra columns of the inputs are not read. Among several
parents the path follows the one with the greatest depth, ties the smallest id. Nodes on a cycle, and
nodes below one, have no path, depth or root (null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import Stage, load

#: Links of one (project, run) up to which the graph is peeled inside one task.
MAX_LINKS = 20_000
#: Entries of paths and descendant lists in one batch that a task hands on.
PORTION = 500_000

NODE_SCHEMA = (
    "project string, run_id string, node_id long, path array<long>, depth int, root_id long, "
    "descendants array<long>, n_descendants long, on_cycle boolean"
)


_ARGS = re.compile(r"<[^<>]*>")
_ANNOTATION = re.compile(r"@\s*[\w.]+\s*(\([^)]*\))?")
_CLAUSE = re.compile(r"\b(extends|implements|super|final)\b|\?")
_SEPARATOR = re.compile(r"\s*(?:\.|\$|::)\s*(?=\w)")
_LAST = re.compile(r"(\w+)[\s\[\]&*.]*$")
_PATH = re.compile(r"(?:\w+\.)+(?=[^\W\d])")
_SPACE = re.compile(r"\s+")
_OWNER_ARGS = re.compile(r"^([^<:]*)<[^:]*>:")


def type_name(raw: str | None) -> str | None:
    """``@A pkg.Outer$Inner<K, V>`` -> ``Inner``; None where no name is left. Type arguments name nothing."""
    if not raw:
        return None
    s, n = raw, 1
    while n:  # nested type arguments, innermost first
        s, n = _ARGS.subn("", s)
    m = _LAST.search(_SEPARATOR.sub(".", _CLAUSE.sub(" ", _ANNOTATION.sub(" ", s))))
    return m[1] if m else None


def method_name(raw: str | None) -> str | None:
    """A method key by the types it means: no packages, annotations, spaces or outer classes; varargs are arrays."""
    if not raw or not raw.strip():
        return None
    s = _ANNOTATION.sub("", raw) if "@" in raw else raw
    s = re.sub(r"\bfinal\s+", "", s).replace("...", "[]")
    s = _SPACE.sub("", _PATH.sub("", _SEPARATOR.sub(".", s)))
    s = _OWNER_ARGS.sub(r"\1:", s)
    if ":<init>(" in s:
        owner, _, rest = s.partition(":<init>")
        s = f"{owner}:{owner}{rest}"
    return s or None


@F.pandas_udf(T.StringType())
def class_simple_name(c: pd.Series) -> pd.Series:
    return c.map({x: type_name(x) for x in c.dropna().unique()})


@F.pandas_udf(T.StringType())
def method_norm_key(c: pd.Series) -> pd.Series:
    return c.map({x: method_name(x) for x in c.dropna().unique()})


def class_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (project, run_id, node_id, node_key) and links (project, run_id, parent, child) of the class rows."""
    h = load(spark, sf_dir, "headers", "header_id", "project", "run_id", "header_key", "parent_class", "interfaces").where("header_key is not null")
    nodes = h.groupBy("project", "run_id", "header_key").agg(F.min("header_id").alias("node_id"))
    named = nodes.select("project", "run_id", "node_id", F.col("header_key").alias("node_key"), class_simple_name(F.col("header_key")).alias("nm"))
    names = h.select("project", "run_id", "header_key", F.explode(F.array_union(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("parent_class"))).alias("raw")).where("raw is not null").distinct()
    names = names.select("project", "run_id", class_simple_name(F.col("header_key")).alias("cnm"), class_simple_name(F.col("raw")).alias("nm")).where("nm is not null").distinct()
    keys = named.select("project", "run_id", F.col("nm"), F.col("node_id"))
    links = (
        names.alias("l")
        .join(keys.alias("p"), F.col("l.project").eqNullSafe(F.col("p.project")) & F.col("l.run_id").eqNullSafe(F.col("p.run_id")) & (F.col("l.nm") == F.col("p.nm")))
        .join(keys.alias("c"), F.col("l.project").eqNullSafe(F.col("c.project")) & F.col("l.run_id").eqNullSafe(F.col("c.run_id")) & (F.col("l.cnm") == F.col("c.nm")))
        .select("l.project", "l.run_id", F.col("p.node_id").alias("parent"), F.col("c.node_id").alias("child"))
        .distinct()
    )
    return named.select("project", "run_id", "node_id", "node_key"), links


def call_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links (caller is the parent) of the method rows; either side's word makes a link."""
    m = load(spark, sf_dir, "methods", "method_id", "project", "run_id", "method_key", "children", "parents").where("method_key is not null")
    nodes = m.groupBy("project", "run_id", "method_key").agg(F.min("method_id").alias("node_id"))
    keys = nodes.select("project", "run_id", "node_id", method_norm_key(F.col("method_key")).alias("nk")).where("nk is not null")
    keys = keys.groupBy("project", "run_id", "nk").agg(F.min("node_id").alias("node_id"))
    empty = F.array().cast("array<string>")
    said = m.select(
        "project", "run_id", "method_key",
        F.explode(F.concat(F.transform(F.coalesce("children", empty), lambda x: F.struct(F.lit(True).alias("down"), x.alias("k"))), F.transform(F.coalesce("parents", empty), lambda x: F.struct(F.lit(False).alias("down"), x.alias("k"))))).alias("s"),
    )
    said = said.where("s.k is not null").distinct().select("project", "run_id", "s.down", method_norm_key(F.col("method_key")).alias("own"), method_norm_key(F.col("s.k")).alias("other")).where("other is not null and own is not null")
    pairs = said.select("project", "run_id", F.when(F.col("down"), F.col("own")).otherwise(F.col("other")).alias("pk"), F.when(F.col("down"), F.col("other")).otherwise(F.col("own")).alias("ck")).distinct()
    eq = lambda a, b, k: F.col(f"{a}.project").eqNullSafe(F.col(f"{b}.project")) & F.col(f"{a}.run_id").eqNullSafe(F.col(f"{b}.run_id")) & (F.col(f"{a}.{k}") == F.col(f"{b}.nk"))
    links = (
        pairs.alias("l")
        .join(keys.alias("p"), eq("l", "p", "pk"))
        .join(keys.alias("c"), eq("l", "c", "ck"))
        .select("l.project", "l.run_id", F.col("p.node_id").alias("parent"), F.col("c.node_id").alias("child"))
        .distinct()
    )
    return nodes.select("project", "run_id", "node_id", F.col("method_key").alias("node_key")), links


def peel(parents: list[int], children: list[int]) -> Iterator[tuple]:
    """Rows (node, path, depth, root, descendants, subtree size, on_cycle) of one graph; isolated nodes do not occur here."""
    ids = sorted({*parents, *children})
    at = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    down: list[list[int]] = [[] for _ in range(n)]
    up: list[list[int]] = [[] for _ in range(n)]
    for p, c in {(at[p], at[c]) for p, c in zip(parents, children)}:
        down[p].append(c)
        up[c].append(p)
    # leaves first: each peeled node sends its descendants and itself to its parents
    desc = [0] * n
    left = [len(x) for x in down]
    ready = [i for i in range(n) if not left[i]]
    order = []
    while ready:
        v = ready.pop()
        order.append(v)
        for p in up[v]:
            desc[p] |= desc[v] | 1 << v
            left[p] -= 1
            if not left[p]:
                ready.append(p)
    residual = [i for i in range(n) if left[i]]
    changed = bool(residual)
    while changed:  # only nodes on or above cycles
        changed = False
        for v in reversed(residual):
            d = desc[v]
            for c in down[v]:
                d |= desc[c] | 1 << c
            if d != desc[v]:
                desc[v] = d
                changed = True
    depth: list[int | None] = [None] * n
    via = [-1] * n

    def place(v: int) -> bool:
        """Depth and parent of ``v`` from its parents, which are placed if they can be."""
        if any(depth[p] is None for p in up[v]):
            return False
        depth[v] = 0
        for p in up[v]:
            if depth[p] + 1 > depth[v] or depth[p] + 1 == depth[v] and p < via[v]:
                depth[v], via[v] = depth[p] + 1, p
        return True

    # residual nodes have residual parents only; those above all cycles are placed, roots first
    ready = [v for v in residual if not up[v]]
    while ready:
        v = ready.pop()
        if depth[v] is None and place(v):
            ready.extend(c for c in down[v] if left[c] and depth[c] is None)
    # the peeled ones in reverse peel order: parents before children
    for v in reversed(order):
        place(v)
    for v in range(n):
        members = []
        d = desc[v]
        size = d.bit_count()
        while d:
            low = d & -d
            members.append(ids[low.bit_length() - 1])
            d ^= low
        if depth[v] is None:
            yield ids[v], None, None, None, members, size, bool(desc[v] >> v & 1)
        else:
            path, x = [], v
            while x >= 0:
                path.append(ids[x])
                x = via[x]
            yield ids[v], path[::-1], depth[v], path[-1], members, size, False


def _peel_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["project", "run_id", "node_id", "path", "depth", "root_id", "descendants", "n_descendants", "on_cycle"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=cols)
        out["depth"] = out["depth"].astype("Int32")
        out["root_id"] = out["root_id"].astype("Int64")
        return out

    for pdf in batches:
        rows, held = [], 0
        for project, run_id, ps, cs in zip(pdf["project"], pdf["run_id"], pdf["ps"], pdf["cs"]):
            for row in peel(list(ps), list(cs)):
                rows.append((project, run_id, *row))
                held += row[5] + len(row[1] or ()) + 1
                if held >= PORTION:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _peel_rounds(spark: SparkSession, links: DataFrame) -> DataFrame:
    """The same for graphs of any size: every peel round is a join; ids are unique over all graphs."""
    st = Stage(spark, "peel")
    links = st.put(links)
    where = st.put(links.select("project", "run_id", F.explode(F.array("parent", "child")).alias("v")).distinct())
    # bottom up: pairs (a, d), leaves first; every round adds a part and reads those of the children peeled just before
    rest = links.select("parent", "child")
    parts: list[DataFrame] = []
    while True:
        inner = rest.select(F.col("parent").alias("child")).distinct()
        leafy = st.put(rest.join(inner, "child", "left_anti"))
        if leafy.isEmpty():
            break
        new = leafy.select(F.col("parent").alias("a"), F.col("child").alias("d"))
        for p in parts:
            new = new.union(leafy.join(p, leafy["child"] == p["a"]).select(leafy["parent"].alias("a"), "d"))
        parts.append(st.put(new.distinct()))
        if len(parts) > 12:  # bounds the plan of a deep graph
            old, parts = parts, [st.put(_all(parts))]
            for p in old:
                st.drop(p)
        old, rest = rest, st.put(rest.join(inner, "child", "left_semi").select("parent", "child"))
        st.drop(old)
    closure = st.put(_all(parts).distinct()) if parts else None
    # residual links: closed over semi-naively, starting from what is known below them
    if not rest.isEmpty():
        base = rest.select(F.col("parent").alias("a"), F.col("child").alias("d"))
        total = st.put((base if closure is None else base.union(closure)).distinct())
        if closure is not None:
            total = st.put(total.union(rest.join(total.withColumnRenamed("a", "child"), "child").select(F.col("parent").alias("a"), "d")).distinct())
        delta = total
        while not delta.isEmpty():
            step = rest.join(delta.withColumnRenamed("a", "child"), "child").select(F.col("parent").alias("a"), "d").distinct()
            delta = st.put(step.join(total, ["a", "d"], "left_anti"))
            total = st.put(total.union(delta))
        closure = total
    # top down, the reverse of the peel order: each round places the nodes whose parents are all placed
    rest = links.select("parent", "child")
    roots = rest.select(F.col("parent").alias("v")).distinct().join(rest.select(F.col("child").alias("v")).distinct(), "v", "left_anti")
    front = st.put(roots.select("v", F.array("v").alias("path")))
    placed = [front]
    best = st.put(spark.createDataFrame([], "child long, o struct<n: int, tie: long, path: array<long>>"))
    while not front.isEmpty():
        offered = rest.join(front.withColumnRenamed("v", "parent"), "parent").select("child", F.struct(F.size("path").alias("n"), (-F.col("parent")).alias("tie"), "path").alias("o"))
        best = st.put(offered.union(best).groupBy("child").agg(F.max("o").alias("o")))
        rest = st.put(rest.join(front.select(F.col("v").alias("parent")), "parent", "left_anti"))
        ready = best.join(rest.select("child").distinct(), "child", "left_anti")
        front = st.put(ready.select(F.col("child").alias("v"), F.concat(F.col("o.path"), F.array("child")).alias("path")))
        best = st.put(best.join(front.select(F.col("v").alias("child")), "child", "left_anti"))
        placed.append(front)
        if len(placed) > 12:
            placed = [st.put(_all(placed))]
    placed = _all(placed)
    lists = closure.groupBy(F.col("a").alias("v")).agg(F.sort_array(F.collect_set("d")).alias("descendants"))
    out = where.join(placed, "v", "left").join(lists, "v", "left")
    desc = F.coalesce("descendants", F.array().cast("array<long>"))
    return out.select(
        "project", "run_id", F.col("v").alias("node_id"), "path", (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root_id"),
        desc.alias("descendants"), F.size(desc).cast("long").alias("n_descendants"), F.array_contains(desc, F.col("v")).alias("on_cycle"),
    ).withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))


def hierarchies(spark: SparkSession, links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """One row per linked node, see ``NODE_SCHEMA``; nodes without links are added by ``full_hierarchies``."""
    st = Stage(spark, "links")
    links = st.put(links)
    sizes = links.groupBy("project", "run_id").count()
    small = sizes.where(F.col("count") <= max_links).drop("count")
    large = sizes.where(F.col("count") > max_links).drop("count")
    same = lambda s: links["project"].eqNullSafe(s["project"]) & links["run_id"].eqNullSafe(s["run_id"])
    # the count comes with the group, so one shuffle serves both the bound and the gathering
    has_large = not large.isEmpty()
    held = links if not has_large else links.join(small, same(small), "left_semi")
    grouped = held.groupBy("project", "run_id").agg(F.collect_list("parent").alias("ps"), F.collect_list("child").alias("cs"))
    out = grouped.mapInPandas(_peel_batches, NODE_SCHEMA)
    if has_large:
        out = out.union(_peel_rounds(spark, links.join(large, same(large), "left_semi")))
    return out


def full_hierarchies(spark: SparkSession, sf_dir: str, link_kind: str, max_links: int = MAX_LINKS) -> DataFrame:
    """One row per node of the kind ``class`` or ``call``, linked or not."""
    nodes, links = (class_graph if link_kind == "class" else call_graph)(spark, sf_dir)
    h = hierarchies(spark, links, max_links).drop("project", "run_id")
    alone = F.col("n_descendants").isNull()
    return nodes.join(h, "node_id", "left").select(
        F.lit(link_kind).alias("link_kind"), "project", "run_id", "node_id", "node_key",
        F.when(alone, F.array("node_id")).otherwise(F.col("path")).alias("path"),
        F.when(alone, F.lit(0)).otherwise(F.col("depth")).alias("depth"),
        F.when(alone, F.col("node_id")).otherwise(F.col("root_id")).alias("root_id"),
        F.when(alone, F.array().cast("array<long>")).otherwise(F.col("descendants")).alias("descendants"),
        F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )


def p2_hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class and method with path, depth, root and all descendants."""
    return full_hierarchies(spark, sf_dir, "class").union(full_hierarchies(spark, sf_dir, "call"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class and method with depth, root, path as text, number of descendants, and whether it lies on a cycle."""
    h = p2_hierarchies(spark, sf_dir)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    return h.select("link_kind", "node_id", "depth", "root_id", path.alias("path"), "n_descendants", "on_cycle")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of nodes of which one is reached from the other."""
    parts = []
    for kind, graph in (("class", class_graph), ("call", call_graph)):
        _, links = graph(spark, sf_dir)
        h = hierarchies(spark, links).select("project", "run_id", "node_id", F.explode("descendants").alias("d"))
        # pairs of one graph come from one task, so the distinct below sees both directions after a map-side combine
        parts.append(h.select(F.lit(kind).alias("link_kind"), F.least("node_id", "d").alias("low_id"), F.greatest("node_id", "d").alias("high_id")))
    return parts[0].union(parts[1]).distinct()
