import json
import pytest

from pyspark.sql import functions as F

from sparkwright.operators import ledger, metrics, providers, reports, rounds, snapshots
from sparkwright.operators.components import connected_components
from sparkwright.sources import files
from sparkwright.streaming import ingest


def test_rates(spark):
    d = spark.createDataFrame([("a", True, 1, 1), ("b", False, 0, 9), ("b", None, None, None)], "k string, ok boolean, n int, t int")
    r = d.agg(metrics.rate(metrics.as_flag(F.col("ok"), False)).alias("x"), metrics.rate(F.col("ok"), F.lit(False), 1.0).alias("one"), metrics.rate(F.col("ok"), F.lit(False)).alias("none"), metrics.micro(F.col("n"), F.col("t")).alias("micro"), metrics.macro(F.col("n") / F.col("t")).alias("macro")).first()
    assert (round(r["x"], 4), r["one"], r["none"], r["micro"], r["macro"]) == (0.3333, 1.0, None, 0.1, 0.5)
    w = spark.createDataFrame([(True, 10), (False, 30)], "ok boolean, loc int").agg(metrics.weighted(F.col("ok"), F.col("loc")).alias("w")).first()["w"]
    assert w == 0.25
    t = spark.createDataFrame([("p", 1, 3), ("p", 3, 5), ("p", 2, 5)], "k string, bs int, s int")
    assert tuple(metrics.best_with_ties(t, ["k"], "bs", "s").first()) == ("p", 5, 2, "2;3")


def test_ledger(spark):
    d = spark.createDataFrame([("k", 1, True, "a"), ("k", 3, False, "b"), ("k", 2, True, "c"), (None, 1, True, "d")], "k string, seq int, valid boolean, v string")
    assert {(r["k"], r["v"]) for r in ledger.last_wins(d, ["k"], ["seq"], F.col("valid")).collect()} == {("k", "c"), (None, "d")}
    assert {(r["k"], r["v"]) for r in ledger.first_of(d, ["k"], ["seq"]).collect()} == {("k", "a"), (None, "d")}
    assert ledger.last_wins(d.limit(0), ["k"], ["seq"]).count() == 0
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("x", 9)], "k string, v int")
    assert {tuple(r) for r in ledger.replace_slice(a, b, ["k"]).collect()} == {("y", 2), ("x", 9)}


def test_rounds(spark):
    d = spark.createDataFrame([("h", 1, False), ("h", 3, True), ("g", 4, None)], "k string, round int, success boolean")
    got = {(r["k"], r["round"]): r["success"] for r in rounds.as_of(d, ["k"], "success", last=4, default=False).collect()}
    assert [got["h", i] for i in (1, 2, 3, 4)] == [False, False, True, True] and not any(got["g", i] for i in (1, 2, 3, 4))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[229] == 200 and len(got) == 41 + 3 + 30
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_reports(spark):
    out = "AB_TEST_START\tone\nAB_TEST_RESULT\tone\tPASS\t\nAB_TEST_RESULT\ttwo\tFAIL\tx\ty\nAB_TEST_RESULT\tbad\nAB_TEST_START\tthree\n"
    runs = spark.createDataFrame([("p", 3, out, 0, -11, False), ("q", 2, None, 1, None, False), ("z", 0, "", 0, None, True)], "project string, planned int, stdout string, compile_returncode int, run_returncode int, timed_out boolean")
    by = {r["project"]: r for r in reports.test_reports(runs).collect()}
    p = by["p"]
    assert (p["status"], p["executed"], round(p["strict_pass_rate"], 4), p["conditional_pass_rate"], p["last_started_test"]) == ("test_failed", 2, 0.3333, 0.5, "three")
    assert by["q"]["status"] == "test_build_failed" and by["q"]["strict_pass_rate"] == 0.0 and by["z"]["status"] == "timeout"
    assert "segmentation" in p["diagnostic"]
    src = spark.createDataFrame([("const int AB_TEST_COUNT = 7;",)], "s string")
    assert src.select(reports.planned_count(F.col("s")).alias("n")).first()["n"] == 7
    assert [r["message"] for r in reports.test_results(runs).orderBy("line_no").collect()] == ["", "x\ty"]
    fr = spark.createDataFrame([("header", 10, 1, True, True, True, True, False), ("method", 30, 2, False, None, False, False, True)], "kind string, source_loc int, query_count int, first_syntax_success boolean, final_syntax_success boolean, first_compile_success boolean, final_compile_success boolean, stubbed boolean")
    al = {r["kind"]: r for r in reports.fragment_report(fr).collect()}["all"]
    assert al["final_compile_success_rate"] == 0.5 and al["final_compile_success_loc_rate"] == 0.25
    tr = spark.createDataFrame([("s", None, "abcd", "efg", 1.0), ("s", 5, None, None, 2.0)], "stage string, total_tokens long, prompt string, response string, elapsed_seconds double")
    assert [reports.token_usage(tr, ["stage"], up).first()["estimated_tokens"] for up in (False, True)] == [1, 2]


def test_snapshots(spark):
    a = spark.createDataFrame([("f", [("int", "1")]), ("g", [("String", '"x"')]), ("h", []), ("k", [("int", "1")])], snapshots.SCHEMA)
    b = spark.createDataFrame([("f", [("long", "1.0")]), ("g", [("String", '"y"')]), ("h", [("int", "1")]), ("z", [])], snapshots.SCHEMA)
    r = snapshots.compare(a, b)
    assert {x["method"]: x["outcome"] for x in r.collect()} == {"f": "ok", "g": "value", "h": "arity", "k": "missing_target", "z": "missing_source"}
    assert snapshots.coverage(r).first()["covered"] == 3


def test_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "A.java").write_bytes("package p.q;\n// import x.Y;\nimport static a.B.c;\nimport d.*;\npublic class A {}\xff".encode("latin-1"))
    r = files.parse_sources(files.java_sources(spark, str(src))).first()
    assert (r["package"], r["qualified_name"], r["imports"]) == ("p.q", "p.q.A", ["a.B.c", "d.*"])
    (tmp_path / "e.txt").write_text("1\t1\ta:x()\t(VIR)b:y()\t7\tvoid\nshort\tline\n2\t0\ta:x()\tc:z()\tbad\n")
    e = files.call_edges(spark, str(tmp_path / "e.txt")).orderBy("call_id").collect()
    assert [(x["callee"], x["call_type"], x["line"]) for x in e] == [("b:y()", "VIR", 7), ("c:z()", "", None)]
    assert files.call_edges(spark, str(tmp_path / "e.txt"), True).count() == 1
    split = tmp_path / "split"
    split.mkdir()
    rec = {"className": "A", "type": "class", "methods": [{"methodName": "f", "methodComment": "注释", "statementCount": 1}]}
    (split / "a.json").write_text(json.dumps(rec, ensure_ascii=False), encoding="utf-8")
    (split / "b.json").write_bytes(json.dumps(rec | {"className": "B"}, ensure_ascii=False).encode("gbk"))
    c, m = files.class_split(spark, str(split))
    assert {x["className"] for x in c.collect()} == {"A", "B"} and {x["methodComment"] for x in m.collect()} == {"注释"}
    (tmp_path / "k.jsonl").write_text('{"fragment_id":"a","v":1}\nnot json\n{"fragment_id":"a","v":2}\n')
    assert [tuple(x) for x in files.keyed_lines(spark, str(tmp_path / "k.jsonl"), "fragment_id string, v int", "fragment_id").collect()] == [("a", 2)]
    for i, d in enumerate(("s1", "s2")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.json").write_text(json.dumps({"class_name": "X", "java_class": f"j{i}", "header_code": "h", "methods": [{"java_signature": "a"}]}))
        (tmp_path / d / "y.json").write_text("{broken")
    assert [x["java_class"] for x in files.stubs(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")]).collect()] == ["j0"]
    df = spark.createDataFrame([("p", "r", [1, 2])], "project string, run_id string, xs array<int>")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.csv(spark, str(tmp_path / "csv"), "project string, run_id string, xs string").first()["xs"] == "1;2"
    files.append_missing(df, str(tmp_path / "st"), ["project"])
    files.append_missing(df, str(tmp_path / "st"), ["project"])
    assert spark.read.parquet(str(tmp_path / "st")).count() == 1
    files.write_graph(df, str(tmp_path / "g"))
    assert "| p | r |" in files.markdown(df.select("project", "run_id")) and "tabular" in files.latex(df.select("project"))
    run = tmp_path / "out" / "v1" / "proj" / "m" / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "x.json").write_text("{}")
    assert tuple(files.runs(spark, str(tmp_path / "out"), ["proj"]).select("version", "project", "ai", "run_id", "n_files").first()) == ("v1", "proj", "m", "r1", 1)
    assert files.runs(spark, str(tmp_path / "out"), None, spark.createDataFrame([("proj", "r1")], "project string, run_id string")).count() == 0
    bar = "=" * 20
    log = f"{bar} one {bar}\nCompiled a.cpp successfully.\n========== Agent repair\n{bar} two {bar}\nFailed to compile a.cpp.\n  Compiled header b.h successfully.\nCompiled c.cpp successfully\n========== Agent repair\nCompiled a.cpp successfully.\n{bar} three {bar}\nCompiled a.cpp successfully."
    status = lambda suffix: [tuple(x) for x in spark.createDataFrame([(log,)], "l string").select(files.run_log_status(F.col("l"), suffix).alias("s")).first()["s"]]
    assert status(".cpp") == [("a.cpp", False)] and status(".h") == [("b.h", True)]
    assert spark.createDataFrame([("nothing",)], "l string").select(files.run_log_status(F.col("l"), ".h").alias("s")).first()["s"] == []


def test_more_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a.cpp", False, "x"), ("b.h", True, "y"), ("c.h", None, None)], "file_name string, success boolean, log_output string")
    files.write_failed_logs(d, str(tmp_path / "f"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("a", "x"), ("c", None)}
    for _ in range(2):
        files.write_round(d, str(tmp_path / "r"), 1)
    files.write_round(d.limit(1), str(tmp_path / "r"), 2)
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("round").count().orderBy("round").collect() == [(1, 3), (2, 1)]
    files.write_summary(d, ["success"], str(tmp_path / "s"))
    assert {(r["success"], r["total"], r["succeeded"]) for r in spark.read.json(str(tmp_path / "s" / "totals")).collect()} == {(True, 1, 1), (False, 1, 0), (None, 1, 0)}
    assert spark.read.json(str(tmp_path / "s" / "results")).count() == 3


def test_providers(spark):
    df = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never"), (4, None)], "id int, prompt string")
    reply = lambda p, n: '{"name": "x"}' if p == "good" or p == "late" and n > 1 else "no"
    got = {r["id"]: (r["reply"], r["tries"]) for r in providers.generate(df.coalesce(1), "id", "prompt", providers.Echo(reply), max_tries=3).collect()}
    assert got == {1: ('{"name": "x"}', 1), 2: ('{"name": "x"}', 2), 3: (None, 3), 4: (None, 0)}
    r = spark.createDataFrame([('{"b": "1"}',), ("{}",)], "r string").select(providers.reply_field(F.col("r"), "a", "b", default="-").alias("x"))
    assert [x["x"] for x in r.collect()] == ["1", "-"]
    assert providers.resolve_config({"a": 1}, {"m": {"a": 2, "b": 3}}, "m", b=None, c=4) == {"a": 2, "b": 3, "c": 4}


def test_grid_is_bounded(spark):
    import pytest

    d = spark.createDataFrame([("a", 1)], "k string, n int")
    dims = [spark.createDataFrame([("a",), ("b",)], "k string")]
    assert metrics.on_grid(d, dims, ["k"], {"n": 0}).count() == 2
    with pytest.raises(ValueError):
        metrics.with_values(d, spark.range(20).selectExpr("cast(id as string) x"), 10)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.jsonl").write_text("\n".join(json.dumps({"run_id": "r", "seq": j, "stage": ["a", " "][j % 2], "total_tokens": j}) for j in range(5)))
    s = ingest.run_to_end(ingest.stage_totals(ingest.trace_stream(spark, str(tmp_path / "t"), 1)), "complete", "t")
    b = ingest.stage_totals(files.traces(spark, str(tmp_path / "t")))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_stores(spark, tmp_path):
    from sparkwright.sources import stores

    (tmp_path / "j").mkdir()
    for name, text in (("a", '{"x": 1}'), ("b", "{broken"), ("c", "")):
        (tmp_path / "j" / f"{name}.json").write_text(text)
    got = {r["path"][-6:]: r["record"] and r["record"]["x"] for r in stores.tolerant_json(spark, str(tmp_path / "j"), "x int").collect()}
    assert got == {"a.json": 1, "b.json": None}  # the reader passes over files without bytes
    assert stores.tolerant_json(spark, str(tmp_path / "absent"), "x int").count() == 0
    f = tmp_path / "conf.json"
    f.write_text('{"m": {"api_key": "k", "base_url": "u", "model": "n"}}')
    assert stores.provider_configs(None, str(f)) == stores.provider_configs('{"m": {"api_key": "k", "base_url": "u", "model": "n"}}', "/absent") and stores.provider_configs() == {}
    for bad in ("[]", '{"m": {"model": "n"}}', "{"):
        with pytest.raises(ValueError):
            stores.provider_configs(bad)
    (tmp_path / "src" / "deep").mkdir(parents=True)
    for name, text in (("A.java", "class A {}"), ("B.java", "// class B"), ("deep/C.java", "class C {}"), ("x.txt", "class X {}")):
        (tmp_path / "src" / name).write_text(text)
    assert tuple(files.parse_summary(files.top_level_sources(spark, str(tmp_path / "src"))).first()) == (1, 1)
    n = spark.createDataFrame([("p", "r", "A:f(List<X>)", 1), ("q", "r", "B:g()", 1)], "project string, run_id string, method_key string, ord long")
    c = spark.createDataFrame([("p", "r", "A:f(List<Y>)", "(VIR)A:h()")], "project string, run_id string, src string, dst string")
    stores.write_graph(n, c, str(tmp_path / "g"))
    stores.write_graph(n.where("project = 'q'"), c.limit(0), str(tmp_path / "g"))
    nodes, calls = stores.read_graph(spark, str(tmp_path / "g"))
    assert {(r["method_key"], r["new_layer"]) for r in nodes.collect()} == {("A:f(List<X>)", 0), ("B:g()", 0)} and calls.count() == 1


def test_keyed_lines_last_one_wins(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(f'{{"k": {i % 7}, "v": {i}}}' for i in range(500)) + "\n\nbroken\n")
    got = {r["k"]: r["v"] for r in files.keyed_lines(spark, str(tmp_path / "s.jsonl"), "k int, v int", "k").collect()}
    assert got == {k: max(i for i in range(500) if i % 7 == k) for k in range(7)}


def test_method_states(spark):
    from sparkwright.operators import mapping

    rows = [
        ("x", "cpp", "", False, False, False, None), ("x", None, "void f()", True, True, False, None), ("x", None, "void f() = 0;", True, False, False, None), ("x", None, "A() = default;", False, False, False, None),
        ("unmapped", None, "void f()", False, False, False, "why"), ("x", None, "void f()", False, False, True, None), ("x", "cpp", "void f()", False, False, True, None), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "s string, l string, d string, h boolean, f boolean, t boolean, w string")
    got = [tuple(r["x"]) for r in df.select(mapping.mapped_state(*map(F.col, "sldhftw")).alias("x")).collect()]
    assert got == [
        ("x", "none", True, "deleted_or_merged"), ("already_implemented", "none", True, "already_implemented"), ("pure_virtual", "none", True, "pure_virtual"), ("defaulted_or_deleted", "none", True, "defaulted_or_deleted"),
        ("unmapped", "none", True, "why"), ("needs_header_body", "header", False, ""), ("needs_cpp_body", "cpp", False, ""), ("deleted_or_merged", "none", True, "deleted_or_merged"),
    ]
    rows = [("cpp", False, False, False, False), ("header", False, False, False, False), ("header", True, False, False, False), (None, False, False, True, False), (None, False, True, False, False), (None, None, None, None, None), ("none", False, False, True, True)]
    df = spark.createDataFrame(rows, "l string, f boolean, d boolean, t boolean, a boolean")
    assert [tuple(r["x"]) for r in df.select(mapping.routing(*map(F.col, "lfdta")).alias("x")).collect()] == [(False, True), (True, False), (False, False), (True, False), (False, False), (False, True), (False, False)]


def test_rules_can_be_added(spark):
    from sparkwright.operators import mapping

    own = mapping.Rule("no-goto", lambda s: s.contains("while"), lambda s, t, h: t.contains("goto"))
    df = spark.createDataFrame([("while (x) {}", "goto a;"), ("x", "goto a;"), (None, "goto a;")], "s string, t string")
    assert [r["x"] for r in df.select(mapping.broken_features(F.col("s"), F.col("t"), F.lit(False), (*mapping.FEATURE_RULES, own)).alias("x")).collect()] == [["no-goto"], [], []]
