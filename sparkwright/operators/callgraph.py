"""Call graphs from recorded edges: resolution, components, layers, peeling, batches.

Graphs belong to a (project, run). Layers of up to ``MAX_LINKS`` links are computed inside one task per graph,
larger ones by rounds of joins over the whole edge table, so that no unbounded graph reaches one task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import Stage
from .hierarchy import MAX_LINKS

KEYS = ["project", "run_id"]


def strip_type(c):
    """``(TYPE)Class:name()`` -> ``Class:name()``."""
    return F.regexp_replace(c, r"^\([A-Z]*\)", "")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each distinct call with its outcome: inner, external (callee unknown), caller_missing, both_missing; self calls are dropped."""
    e = edges.select(*KEYS, "src", strip_type(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    known = nodes.select(*KEYS, F.col("method_key").alias("k")).where("k is not null").distinct()
    a = known.select(*KEYS, F.col("k").alias("src"), F.lit(True).alias("src_known"))
    b = known.select(*KEYS, F.col("k").alias("dst"), F.lit(True).alias("dst_known"))
    out = e.join(a, [*KEYS, "src"], "left").join(b, [*KEYS, "dst"], "left")
    s, d = F.coalesce("src_known", F.lit(False)), F.coalesce("dst_known", F.lit(False))
    return out.select(*KEYS, "src", "dst", F.when(s & d, "inner").when(s, "external").when(d, "caller_missing").otherwise("both_missing").alias("outcome"))


def erased_key(c, depth: int = 4):
    """A method key by which calls find methods: no packages, no type arguments, no blanks."""
    from ..functions.text import erase_generics

    return F.regexp_replace(erase_generics(F.regexp_replace(c, r"\s+", ""), depth=depth), r"(?:[A-Za-z_]\w*\.)+([A-Za-z_])", "$1")


def first_by_key(nodes: DataFrame, order: str) -> DataFrame:
    """(project, run_id, key, node): the first method of each erased key; overloads that erasure makes equal share it."""
    n = nodes.where("method_key is not null").select(*KEYS, erased_key(F.col("method_key")).alias("key"), F.col("method_key").alias("node"), order)
    return n.groupBy(*KEYS, "key").agg(F.min_by("node", F.struct(F.col(order).isNull(), order, "node")).alias("node"))


def resolve_erased(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Distinct calls by erased keys with their outcome; self calls are dropped. Ends that no method answers keep their own key."""
    e = edges.where("src is not null and dst is not null").select(*KEYS, erased_key(F.col("src")).alias("sk"), erased_key(strip_type(F.col("dst"))).alias("dk")).where("sk <> dk").distinct()
    known = first_by_key(nodes, order)
    out = e.join(known.select(*KEYS, F.col("key").alias("sk"), F.col("node").alias("s")), [*KEYS, "sk"], "left").join(known.select(*KEYS, F.col("key").alias("dk"), F.col("node").alias("d")), [*KEYS, "dk"], "left")
    outcome = F.when(F.col("s").isNotNull() & F.col("d").isNotNull(), "inner").when(F.col("s").isNotNull(), "external").when(F.col("d").isNotNull(), "caller_missing").otherwise("both_missing")
    return out.select(*KEYS, F.coalesce("s", "sk").alias("src"), F.coalesce("d", "dk").alias("dst"), outcome.alias("outcome"))


def built_graph(spark: SparkSession, edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Every method with component and layer: calls resolved, cycles condensed, callees first; methods without calls lie on layer 0."""
    inner = resolve_erased(edges, nodes, order).where("outcome = 'inner'").select(*KEYS, "src", "dst")
    lay = layers(spark, inner).select(*KEYS, "node", "component", "component_size", "layer")
    every = nodes.where("method_key is not null").select(*KEYS, F.col("method_key").alias("node")).distinct()
    return every.join(lay, [*KEYS, "node"], "left").select(*KEYS, "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_size", F.lit(1)).alias("component_size"), F.coalesce("layer", F.lit(0)).alias("layer"))


def injected(edges: DataFrame, nodes: DataFrame, owners: DataFrame, order: str) -> DataFrame:
    """``nodes`` and the callees that no method answers but whose class is one of ``owners`` (project, run_id, owner): to be wired and layered anew."""
    missing = resolve_erased(edges, nodes, order).where("outcome = 'external'").select(*KEYS, F.col("dst").alias("method_key")).distinct()
    missing = missing.withColumn("owner", F.regexp_extract("method_key", r"^([^:]*):", 1)).join(owners.distinct(), [*KEYS, "owner"], "left_semi")
    return nodes.select(*KEYS, "method_key", order).unionByName(missing.select(*KEYS, "method_key", F.lit(None).cast("long").alias(order)))


def dependency_order(spark: SparkSession, items: DataFrame, key, dependencies, order: str) -> DataFrame:
    """(project, run_id, node, component, layer, position) of ``items`` by the columns ``key`` and ``dependencies`` (an array of keys).

    Dependencies first, members of a cycle together, else the given order. Unknown keys are no dependencies.
    """
    x = items.select(*KEYS, key.alias("node"), order).where("node is not null").groupBy(*KEYS, "node").agg(F.min(order).alias(order))
    d = items.select(*KEYS, key.alias("src"), F.explode(dependencies).alias("dst")).where("src <> dst").distinct()
    d = d.join(x.select(*KEYS, F.col("node").alias("dst")), [*KEYS, "dst"], "left_semi").select(*KEYS, "src", "dst")
    lay = layers(spark, d).select(*KEYS, "node", "component", "layer")
    y = x.join(lay, [*KEYS, "node"], "left").select(*KEYS, "node", F.coalesce("component", "node").alias("component"), F.coalesce("layer", F.lit(0)).alias("layer"), order)
    first = y.groupBy(*KEYS, "component").agg(F.min(F.struct(F.col(order).isNull().alias("u"), F.col(order).alias("o"), F.col("node").alias("n"))).alias("first"))
    w = Window.partitionBy(*KEYS).orderBy("layer", "first", F.col(order).asc_nulls_last(), "node")
    return y.join(first, [*KEYS, "component"]).select(*KEYS, "node", "component", "layer", F.row_number().over(w).alias("position"))


def _kosaraju(n: int, down: list[list[int]], up: list[list[int]]) -> list[int]:
    """Component numbers, without recursion."""
    order, seen = [], [False] * n
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        stack = [(s, iter(down[s]))]
        while stack:
            v, it = stack[-1]
            for w in it:
                if not seen[w]:
                    seen[w] = True
                    stack.append((w, iter(down[w])))
                    break
            else:
                order.append(v)
                stack.pop()
    comp = [-1] * n
    c = 0
    for s in reversed(order):
        if comp[s] >= 0:
            continue
        comp[s] = c
        todo = [s]
        while todo:
            v = todo.pop()
            for w in up[v]:
                if comp[w] < 0:
                    comp[w] = c
                    todo.append(w)
        c += 1
    return comp


def graph_layers(src: list[str], dst: list[str]) -> list[tuple[str, str, int, int, int]]:
    """(node, component, component size, layer, peel round): callees lie below callers, members of a cycle share a layer.

    Peeling takes nodes without open callees round by round; what is left lies on or above cycles and shares the last round.
    """
    ids = sorted({*src, *dst})
    at = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    down: list[list[int]] = [[] for _ in range(n)]
    up: list[list[int]] = [[] for _ in range(n)]
    for a, b in {(at[a], at[b]) for a, b in zip(src, dst)}:
        down[a].append(b)
        up[b].append(a)
    comp = _kosaraju(n, down, up)
    k = max(comp) + 1
    members: list[list[int]] = [[] for _ in range(k)]
    for v, c in enumerate(comp):
        members[c].append(v)
    below = [{comp[w] for v in m for w in down[v]} - {c} for c, m in enumerate(members)]
    above: list[list[int]] = [[] for _ in range(k)]
    for c, bs in enumerate(below):
        for b in bs:
            above[b].append(c)
    level, open_ = [0] * k, [len(b) for b in below]
    ready = [c for c in range(k) if not open_[c]]
    while ready:
        c = ready.pop()
        for a in above[c]:
            level[a] = max(level[a], level[c] + 1)
            open_[a] -= 1
            if not open_[a]:
                ready.append(a)
    peel, left = [-1] * n, [len(d) for d in down]
    front, r = [v for v in range(n) if not left[v]], 0
    while front:
        nxt = []
        for v in front:
            peel[v] = r
        for v in front:
            for a in up[v]:
                left[a] -= 1
                if not left[a]:
                    nxt.append(a)
        front, r = nxt, r + 1
    return [(ids[v], ids[min(members[comp[v]])], len(members[comp[v]]), level[comp[v]], peel[v] if peel[v] >= 0 else r) for v in range(n)]


LAYERS = "project string, run_id string, node string, component string, component_size int, layer int, peel_round int"


def _layer_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [x.split()[0] for x in LAYERS.split(", ")]
    for pdf in batches:
        rows = [(p, r, *x) for p, r, a, b in zip(pdf["project"], pdf["run_id"], pdf["ss"], pdf["ds"]) for x in graph_layers(list(a), list(b))]
        yield pd.DataFrame(rows, columns=cols).astype({"component_size": "int32", "layer": "int32", "peel_round": "int32"})


def layers(spark: SparkSession, links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """``LAYERS`` for each linked node of ``links`` (project, run_id, src, dst)."""
    st = Stage(spark, "layers")
    links = st.put(links.select(*KEYS, "src", "dst").where("src <> dst").distinct())
    sizes = links.groupBy(*KEYS).count()
    large = sizes.where(F.col("count") > max_links).select(*KEYS)
    if large.isEmpty():
        return links.groupBy(*KEYS).agg(F.collect_list("src").alias("ss"), F.collect_list("dst").alias("ds")).mapInPandas(_layer_batches, LAYERS)
    held = links.join(large, KEYS, "left_anti").groupBy(*KEYS).agg(F.collect_list("src").alias("ss"), F.collect_list("dst").alias("ds")).mapInPandas(_layer_batches, LAYERS)
    return held.union(_layers_by_rounds(spark, st.put(links.join(large, KEYS, "left_semi"))))


def _strong_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(project, run_id, node, component, component_size) of the components of more than one node, without any closure.

    Nodes without callers or callees are trimmed. The others take the largest name that reaches them as their colour; what
    reaches the node of that name backward within its colour is its component, which leaves. So until no link is left.
    """
    st, found, rest = Stage(spark, "colours"), [], links
    while True:
        n = -1
        while True:  # trimming
            core = rest.select(*KEYS, F.col("src").alias("v")).intersect(rest.select(*KEYS, F.col("dst").alias("v")))
            core = st.put(core)
            rest = st.put(rest.join(core.withColumnRenamed("v", "src"), [*KEYS, "src"], "left_semi").join(core.withColumnRenamed("v", "dst"), [*KEYS, "dst"], "left_semi").select(*KEYS, "src", "dst"))
            m = rest.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = core.select(*KEYS, "v", F.col("v").alias("c"), F.lit(True).alias("moved"))
        while True:  # the largest name that reaches each node; only what rose is sent on
            offers = rest.join(colour.where("moved").select(*KEYS, F.col("v").alias("src"), "c"), [*KEYS, "src"]).select(*KEYS, F.col("dst").alias("v"), F.col("c").alias("o")).groupBy(*KEYS, "v").agg(F.max("o").alias("o"))
            new = colour.join(offers, [*KEYS, "v"], "left")
            rose = F.coalesce(F.col("o") > F.col("c"), F.lit(False))
            colour = st.put(new.select(*KEYS, "v", F.when(rose, F.col("o")).otherwise(F.col("c")).alias("c"), rose.alias("moved")))
            if colour.where("moved").isEmpty():
                break
        colour = colour.drop("moved")
        same = st.put(rest.join(colour.withColumnsRenamed({"v": "src", "c": "a"}), [*KEYS, "src"]).join(colour.withColumnsRenamed({"v": "dst", "c": "b"}), [*KEYS, "dst"]).where("a = b").select(*KEYS, "src", "dst"))
        front = reached = st.put(colour.where("v = c"))
        while not front.isEmpty():  # backward within a colour
            step = same.join(front.withColumnRenamed("v", "dst"), [*KEYS, "dst"]).select(*KEYS, F.col("src").alias("v"), "c").distinct()
            front = st.put(step.join(reached, [*KEYS, "v", "c"], "left_anti"))
            reached = st.put(reached.union(front))
        found.append(reached)
        rest = st.put(rest.join(reached.select(*KEYS, F.col("v").alias("src")), [*KEYS, "src"], "left_anti").join(reached.select(*KEYS, F.col("v").alias("dst")), [*KEYS, "dst"], "left_anti"))
    out = spark.createDataFrame([], "project string, run_id string, node string, component string, component_size int")
    for r in found:
        label = r.groupBy(*KEYS, "c").agg(F.min("v").alias("component"), F.count(F.lit(1)).cast("int").alias("component_size")).where("component_size > 1")
        out = out.union(r.join(label, [*KEYS, "c"]).select(*KEYS, F.col("v").alias("node"), "component", "component_size"))
    return st.put(out)


def _layers_by_rounds(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Components by colours, layers and peel rounds by repeated joins."""
    st = Stage(spark, "rounds")
    names = links.select(*KEYS, F.explode(F.array("src", "dst")).alias("node")).distinct()
    big = _strong_components(spark, links)
    node = st.put(names.join(big, [*KEYS, "node"], "left").select(*KEYS, "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_size", F.lit(1)).alias("component_size")))
    small = node.select(*KEYS, "node", "component")
    ce = links.join(small.withColumnsRenamed({"node": "src", "component": "ca"}), [*KEYS, "src"]).join(small.withColumnsRenamed({"node": "dst", "component": "cb"}), [*KEYS, "dst"])
    ce = st.put(ce.where("ca <> cb").select(*KEYS, "ca", "cb").distinct())

    def rounds(edges: DataFrame, a: str, b: str, nodes: DataFrame) -> DataFrame:
        """Round in which each node has no open edge ``a`` -> ``b`` left; null for what is never free."""
        rest, open_nodes, done, r = edges, nodes, None, 0
        while True:
            busy = rest.select(*KEYS, F.col(a).alias("v")).distinct()
            free = st.put(open_nodes.join(busy, [*KEYS, "v"], "left_anti").withColumn("r", F.lit(r)))
            if free.isEmpty():
                break
            done = free if done is None else st.put(done.union(free))
            gone = free.select(*KEYS, "v")
            rest = st.put(rest.join(gone.withColumnRenamed("v", b), [*KEYS, b], "left_anti"))
            open_nodes = st.put(open_nodes.join(gone, [*KEYS, "v"], "left_anti"))
            r += 1
        if done is None:
            return open_nodes.withColumn("r", F.lit(0))
        ended = done.groupBy(*KEYS).agg((F.max("r") + 1).alias("r"))  # the last round of each graph
        return done.union(open_nodes.join(ended, KEYS, "left").select(*open_nodes.columns, F.coalesce("r", F.lit(0)).alias("r")))

    level = rounds(ce, "ca", "cb", node.select(*KEYS, F.col("component").alias("v")).distinct()).withColumnsRenamed({"v": "component", "r": "layer"})
    peeled = rounds(links.select(*KEYS, F.col("src").alias("a"), F.col("dst").alias("b")), "a", "b", node.select(*KEYS, F.col("node").alias("v"))).withColumnsRenamed({"v": "node", "r": "peel_round"})
    return node.join(level, [*KEYS, "component"]).join(peeled, [*KEYS, "node"]).select(*KEYS, "node", "component", "component_size", "layer", "peel_round")


def batches(items: list[tuple[str, list[str], set[str]]], size: int, seed: int | None = None) -> list[list[str]]:
    """Greedy batches of at most ``size`` of (key, related keys in order of nearness, keys related by inheritance) in topological order.

    A base takes its related keys first; what room is left goes, in order, to keys without relatives by inheritance or with
    one in the batch. With a seed the order is shuffled and simply cut.
    """
    if size < 1:
        raise ValueError("size must be positive")
    order = [k for k, _, _ in items]
    if seed is not None:
        random.Random(seed).shuffle(order)
        return [order[i : i + size] for i in range(0, len(order), size)]
    near, kin = {k: r for k, r, _ in items}, {k: r for k, _, r in items}
    left, out = dict.fromkeys(order), []
    while left:
        base = next(iter(left))
        batch = [base]
        del left[base]
        for k in near[base]:
            if len(batch) < size and k in left:
                batch.append(k)
                del left[k]
        for k in list(left):
            if len(batch) >= size:
                break
            if not kin[k] or kin[k] & set(batch):
                batch.append(k)
                del left[k]
        out.append(batch)
    return out


def canonical_cycle(nodes: list[str], undirected: bool = False) -> tuple[str, ...]:
    """The smallest rotation of a cycle (given with or without its first node repeated), of its reverse too if undirected."""
    body = nodes[:-1] if len(nodes) > 1 and nodes[0] == nodes[-1] else list(nodes)
    turns = [tuple(body[i:] + body[:i]) for i in range(len(body))]
    if undirected:
        back = body[::-1]
        turns += [tuple(back[i:] + back[:i]) for i in range(len(back))]
    return min(turns) if turns else ()


def back_edge_cycles(graph: dict[str, list[str]], undirected: bool = False) -> list[tuple[str, ...]]:
    """Cycles that a depth-first search closes, neighbours in sorted order; not all elementary cycles."""
    found, color = set(), {}
    for root in sorted(graph):
        if root in color:
            continue
        path, stack = [root], [(root, iter(sorted(graph.get(root, ()))))]
        color[root] = 1
        while stack:
            v, it = stack[-1]
            for w in it:
                if color.get(w) == 1:
                    found.add(canonical_cycle(path[path.index(w) :], undirected))
                elif w not in color:
                    color[w] = 1
                    path.append(w)
                    stack.append((w, iter(sorted(graph.get(w, ())))))
                    break
            else:
                color[v] = 2
                path.pop()
                stack.pop()
    return sorted(found)


CYCLES = "project string, run_id string, cycle string, length int"


def _cycle_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    graph: dict[str, list[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"]):
        graph.setdefault(a, []).append(b)
    rows = [(pdf["project"].iloc[0], pdf["run_id"].iloc[0], " > ".join(c), len(c)) for c in back_edge_cycles(graph)]
    return pd.DataFrame(rows, columns=["project", "run_id", "cycle", "length"])


def component_cycles(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``CYCLES`` of ``links`` (project, run_id, src, dst): links that leave a component close none, so components are searched each for itself."""
    c = layers(spark, links).where("component_size > 1").select(*KEYS, "node", "component")
    inside = links.join(c.withColumnsRenamed({"node": "src", "component": "a"}), [*KEYS, "src"]).join(c.withColumnsRenamed({"node": "dst", "component": "b"}), [*KEYS, "dst"]).where("a = b")
    return inside.select(*KEYS, "a", "src", "dst").groupBy(*KEYS, "a").applyInPandas(_cycle_rows, CYCLES)
