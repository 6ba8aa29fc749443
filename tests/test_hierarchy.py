import random

import pytest

from sparkwright.operators import callgraph
from sparkwright.operators.hierarchy import full_hierarchies, hierarchies, method_name, p2_found, peel, type_name

HEADERS = "header_id long, project string, run_id string, header_key string, parent_class string, interfaces array<string>, node_id string"
METHODS = "method_id long, project string, run_id string, method_key string, children array<string>, parents array<string>"


def brute(edges):
    reach = {v: set() for e in edges for v in e}
    for v in reach:
        todo = [v]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in reach[v]:
                    reach[v].add(b)
                    todo.append(b)
    return reach


def test_names():
    assert type_name("@NonNull a.b.Outer$Inner<K, Map<V, W>>") == "Inner"
    assert type_name("  Foo < K , V > ") == "Foo"
    assert type_name("Outer.Inner") == type_name("Outer$Inner") == "Inner"
    assert type_name("") is None and type_name(None) is None and type_name(" <T> ") is None
    assert method_name(" A$B:f(java.util.List<java.lang.String>, int) ") == method_name("B:f(List<String>,int)") == "B:f(List<String>,int)"
    assert method_name("p.A:<init>(int...)") == "A:A(int[])"
    assert method_name("A:f(@X final String)") == "A:f(String)"
    assert method_name(" ") is None


def test_peel_against_brute_force():
    rng = random.Random(3)
    for n in range(200):
        k = rng.randrange(1, 14)
        edges = {(rng.randrange(k), rng.randrange(k)) for _ in range(rng.randrange(1, 20))}
        rows = peel([a for a, _ in edges], [b for _, b in edges])
        want = brute(edges)
        for v, path, depth, root, desc, size, cyc in rows:
            assert set(desc) == want[v] and size == len(desc) and cyc == (v in want[v]), (n, edges)
            below_cycle = any(v in want[c] and c in want[c] for c in want)
            assert (path is None) == below_cycle, (n, edges)
            if path:
                assert path[0] == root and path[-1] == v and len(path) == depth + 1
                assert all((a, b) in edges for a, b in zip(path, path[1:]))
                assert not any(v in want[c] and c in want[c] for c in want)


@pytest.mark.parametrize("bound", [0, 100_000])
def test_both_executions_agree(spark, bound):
    rng = random.Random(5)
    ring = {("p", "ring", 900 + i, 900 + (i + 1) % 4) for i in range(4)}
    rows = ring | {("p", f"r{g}", 100 * g + rng.randrange(9), 100 * g + rng.randrange(9)) for g in range(3) for _ in range(9)}
    got = hierarchies(spark, spark.createDataFrame(sorted(rows), "project string, run_id string, parent long, child long"), bound).collect()
    want = brute({(a, b) for _, _, a, b in rows})
    assert {r["node_id"]: set(r["descendants"]) for r in got} == want
    mine = {x[0]: x for g in ("r0", "r1", "r2", "ring") for x in peel([a for _, r, a, _ in rows if r == g], [b for _, r, _, b in rows if r == g])}
    for r in got:
        v = mine[r["node_id"]]
        assert (r["path"], r["depth"], r["root_id"], r["on_cycle"]) == (v[1], v[2], v[3], v[6])


def test_a_ring_alone_by_rounds(spark):
    got = hierarchies(spark, spark.createDataFrame([("p", "r", i, (i + 1) % 3) for i in range(3)], "project string, run_id string, parent long, child long"), 0).collect()
    assert {(r["node_id"], tuple(r["descendants"]), r["on_cycle"], r["path"], r["depth"]) for r in got} == {(i, (0, 1, 2), True, None, None) for i in range(3)}


def test_portions_hold_all_rows(spark, monkeypatch):
    from sparkwright.operators import hierarchy

    monkeypatch.setattr(hierarchy, "PORTION", 7)
    edges = [(i, i + 1) for i in range(40)]
    frame = hierarchy.pd.DataFrame({"project": ["p"], "run_id": ["r"], "ps": [[a for a, _ in edges]], "cs": [[b for _, b in edges]]})
    parts = list(hierarchy._peel_batches(iter([frame])))
    assert len(parts) > 20 and sum(map(len, parts)) == 41 and max(p["n_descendants"].sum() for p in parts) < 100


def test_edge_cases(spark, table_dir):
    h = spark.createDataFrame(
        [
            (1, "p", "r", "A", None, None, "x"),
            (2, "p", "r", "B", "x.A<T>", [None, ""], "x"),
            (9, "p", "r", "B", "x.A<T>", [None, ""], "x"),
            (3, "p", "r", "C", "Unknown", ["B", "B"], None),
            (4, "p", "q", "D", "A", [], None),
            (5, "p", "r", None, "A", [], None),
            (6, None, "r", "S", "S", [], None),
        ],
        HEADERS,
    )
    m = spark.createDataFrame([(1, "p", "r", "A:f()", ["A:f()", None, "Math:max(int,int)"], None), (2, "p", "r", "A:g()", None, [" A:f() "])], METHODS)
    d = table_dir(headers=h, methods=m)
    assert {tuple(r) for r in p2_found(spark, d).collect()} == {("class", 1, 2), ("class", 2, 3), ("class", 1, 3), ("class", 6, 6), ("call", 1, 1), ("call", 1, 2)}
    by = {r["node_id"]: r for r in full_hierarchies(spark, d, "class").collect()}
    assert by[3]["path"] == [1, 2, 3] and by[3]["depth"] == 2 and by[4]["path"] == [4] and by[6]["on_cycle"] and by[6]["path"] is None
    empty = table_dir(headers=h.limit(0), methods=m.limit(0))
    assert p2_found(spark, empty).count() == 0


def test_layers(spark):
    rows = [("p", "r", a, b) for a, b in ("ab", "bc", "cb", "cd", "ed", "bc")]
    e = spark.createDataFrame(rows, "project string, run_id string, src string, dst string")
    for bound in (0, 1000):
        got = {r["node"]: (r["component"], r["component_size"], r["layer"], r["peel_round"]) for r in callgraph.layers(spark, e, bound).collect()}
        assert got == {"d": ("d", 1, 0, 0), "b": ("b", 2, 1, 2), "c": ("b", 2, 1, 2), "e": ("e", 1, 1, 1), "a": ("a", 1, 2, 2)}, bound


def test_components_by_colours(spark):
    rng = random.Random(9)
    rows = sorted({("p", f"r{g}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for g in range(2) for _ in range(13)})
    e = spark.createDataFrame([r for r in rows if r[2] != r[3]], "project string, run_id string, src string, dst string")
    one, many = (sorted(map(tuple, callgraph.layers(spark, e, b).collect())) for b in (1000, 0))
    assert one == many and max(r[4] for r in one) > 2


def test_edges(spark):
    nodes = spark.createDataFrame([("p", "r", "A:x()"), ("p", "r", "B:y()")], "project string, run_id string, method_key string")
    calls = [("A:x()", "(VIR)B:y()"), ("A:x()", "B:y()"), ("A:x()", "A:x()"), ("A:x()", "(STA)Z:q()"), ("Z:q()", "B:y()"), ("Z:q()", "Z:r()"), (None, "B:y()")]
    e = spark.createDataFrame([("p", "r", a, b) for a, b in calls], "project string, run_id string, src string, dst string")
    assert {(r["src"], r["dst"], r["outcome"]) for r in callgraph.resolve_edges(e, nodes).collect()} == {("A:x()", "B:y()", "inner"), ("A:x()", "Z:q()", "external"), ("Z:q()", "B:y()", "caller_missing"), ("Z:q()", "Z:r()", "both_missing")}


def test_cycles_and_batches():
    assert callgraph.canonical_cycle(list("bcab"), True) == callgraph.canonical_cycle(list("bacb"), True) == ("a", "b", "c")
    assert callgraph.canonical_cycle(list("bcab")) == ("a", "b", "c") and callgraph.canonical_cycle(list("bacb")) == ("a", "c", "b")
    assert callgraph.back_edge_cycles({"a": ["b"], "b": ["c"], "c": ["a", "d"], "d": ["d"]}) == [("a", "b", "c"), ("d",)]
    items = [(k, {"D": ["B"], "B": ["D"], "A": ["E"]}.get(k, []), {"D": {"B"}, "B": {"D"}}.get(k, set())) for k in "ABCDE"]
    # A takes the near E; B takes its relative D; C is left; nobody else's relative fills a batch
    assert callgraph.batches(items, 2) == [["A", "E"], ["B", "D"], ["C"]]
    assert callgraph.batches(items, 3) == [["A", "E", "C"], ["B", "D"]]
    assert sorted(sum(callgraph.batches(items, 2, seed=4), [])) == list("ABCDE") and [len(b) for b in callgraph.batches(items, 2, seed=4)] == [2, 2, 1]
    with pytest.raises(ValueError):
        callgraph.batches(items, 0)


def test_orders_and_cycles(spark):
    h = spark.createDataFrame([("p", "r", "A", ["B", "Z", None], 2), ("p", "r", "B", ["C"], 1), ("p", "r", "C", ["B"], 3), ("p", "r", "D", None, None), ("p", "r", None, [], 0)], "project string, run_id string, k string, deps array<string>, ord long")
    got = [(r["node"], r["component"], r["layer"]) for r in callgraph.dependency_order(spark, h, callgraph.F.col("k"), callgraph.F.col("deps"), "ord").orderBy("position").collect()]
    assert got == [("B", "B", 0), ("C", "B", 0), ("D", "D", 0), ("A", "A", 1)]
    e = spark.createDataFrame([("p", "r", a, b) for a, b in ("ab", "ba", "bc", "cd", "de", "ec")], "project string, run_id string, src string, dst string")
    assert {(r["cycle"], r["length"]) for r in callgraph.component_cycles(spark, e).collect()} == {("a > b", 2), ("c > d > e", 3)}
