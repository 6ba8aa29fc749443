import json

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import rules, text
from sparkwright.operators import diagnostics, mapping


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"c {typ}").select(fn(F.col("c")).alias("x")).first()["x"]


def test_signatures(spark):
    assert one(spark, "a.b.C:run(java.lang.String s,int)", text.standard_signature) == "C:run(String,int)"
    assert one(spark, "a.b.C:<init>()", text.standard_signature) == "C:C()"
    assert one(spark, "noColon", text.standard_signature) is None
    assert one(spark, "C:g(Map<A,List<B>>)", lambda c: text.erase_generics(c, legacy=True)) == "C:g(Map>)"
    assert one(spark, "C:g(Map<A,List<B>>)", text.erase_generics) == "C:g(Map)"
    assert text.normalize_signature("public <T> void run(final java.util.List<String> xs, int... ys) throws E") == "run(List,int...)"
    assert text.split_top("Map<A,B> m, int[] x, F<(a,b)> y") == ["Map<A,B> m", "int[] x", "F<(a,b)> y"]
    assert one(spark, "a.Outer$Inner<T>", text.name_candidates) == ["a.Outer$Inner", "Outer$Inner", "Inner", "a.Outer::Inner"]
    assert one(spark, "p.C:f(int)", text.signature_keys) == ["p.C:f(int)", "C:f(int)", "f(int)"]


def test_file_names(spark):
    assert one(spark, "A<B>:c?", text.sanitize_filename) == "A-B--c+"
    assert one(spark, "con", text.sanitize_filename) == "_con"
    s = one(spark, "x" * 90, text.short_graph_filename)
    assert s.startswith("x" * 60 + "_") and len(s) == 60 + 1 + 12 + 5


def test_rules(spark):
    want = {"no viable conversion from incomplete type 'X'": "Type Error", "field has incomplete type": "Undefined Symbols", "zzz": "Other Errors", "expected ';' after": "Syntax Rule Violation", "'virtual' can only appear": "Syntax Rule Violation", "x file not found": "Header File Error", "redefinition of 'x'": "Duplicated Definitions"}
    for m, c in want.items():
        assert one(spark, m, rules.classify) == c, m
    assert one(spark, None, rules.classify) is None
    assert one(spark, "a.cpp:1:2: error: b [-Wx]\nfatal error: too many errors emitted\nc: error: b", rules.error_lines) == ["b"]
    assert one(spark, "unknown type name 'T'; expected ';'", rules.issue_types) == ["template_or_syntax", "unknown_type"]
    assert one(spark, "nothing", rules.issue_types) == ["compile_error"]


def test_code():
    assert text.strip_comments('a /* b */ "// no" // c\nd') == 'a  "// no" \nd'
    assert text.json_part('x {bad} {"a":[1,{"b":"}"}]} y') == '{"a":[1,{"b":"}"}]}'
    assert text.json_part("{bad} y") == "{bad}" and text.json_part("none") is None
    assert text.canonical_json('{"b":1.0,"a":-0.0,"c":true}') == '{"a":0,"b":1,"c":true}'
    with pytest.raises(ValueError):
        text.canonical_json("NaN")


def test_types():
    java, cpp, same = text.java_type_ir, text.cpp_type_ir, text.same_type
    assert java("java.util.Map<String, List<Integer>>") == "map(string,sequence(object))" and cpp("const std::map<std::string, std::vector<int32_t>>&") == "map(string,sequence(int))"
    assert cpp("const std::shared_ptr<Foo>&") == "object(object)?" and java("a.b.Foo") == "object" and java("@X final int[]...") == "array(array(int))" and cpp("char*") == "string?" and java("t") == "unknown"
    assert same(java("int[]"), cpp("std::vector<int>")) and same(java("char[]"), cpp("std::string")) and not same(java("String"), cpp("int")) and same("unknown", "int")
    # widths are kept apart; a value may become optional, an optional no value
    assert not same(java("long"), cpp("int32_t")) and same(java("long"), cpp("int64_t")) and same(java("byte"), cpp("signed char"))
    assert same(java("int"), cpp("std::optional<int>")) and not same(java("Optional<String>"), cpp("std::string")) and same(java("Future<String>"), cpp("std::future<std::string>")) and not same(java("Future<String>"), cpp("Foo"))
    assert not same(java("Map<String,Long>"), cpp("std::map<int, Foo>")) and same(java("Map"), cpp("std::map<int, int>")) and not same(java("Set<int>"), cpp("std::vector<int>"))


def test_blocks(spark):
    log = "\n".join(["In file included from a:1:", "In file included from b:1:", "In file included from c:1:", "In file included from d:1:", "x.h:1:2: error: one", "note", "", "y.h:3:4: error: two"])
    got = diagnostics.diagnostic_blocks(log)
    assert len(got) == 2 and all(b.count("In file included") == 2 for b in got)
    assert diagnostics.diagnostic_blocks("quiet") == ["quiet"] and diagnostics.diagnostic_blocks("") == []
    assert diagnostics.resolve_location("/sys/x.h:1:2: error: e\nsrc/a.h:7:1: note: n", {"src/a.h"}) == ("src/a.h", 7, 1)
    assert diagnostics.scope("src/a.h:1:2: error: e", "src/a.h", {"src/a.h"}) == "local"
    assert diagnostics.scope("b.h:1:2: error: e", "src/a.h", {"src/b.h"}) == "project" and diagnostics.scope("/u/z.h:1:2: error: e", "a.h", {"b.h"}) == "external"
    long = "In file included from q:1:\n" * 50 + "error: x"
    assert one(spark, long, lambda c: diagnostics.compact_log(c, 100)) == "error: x"


def test_patches(spark):
    f = spark.createDataFrame([("a", "x y x"), ("b", "p q"), ("c", "z")], "file string, content string")
    p = spark.createDataFrame([("a", "x", "n"), ("b", "p", "n"), ("c", "k", "n")], "file string, original string, new string")
    assert {r["file"]: (r["outcome"], r["content"]) for r in mapping.apply_patches(f, p, "file").collect()} == {"a": ("rejected", "x y x"), "b": ("applied", "n q"), "c": ("rejected", "z")}


def test_status(spark):
    rows = [("void f() {", False, False, False, "already_implemented"), ("void f();", True, False, False, "needs_header_body"), ("virtual void f() = 0;", False, False, False, "pure_virtual"), ("A() = default;", False, False, False, "defaulted_or_deleted"), (None, False, False, False, "unmapped"), ("int x", False, False, False, "invalid_cpp_definition"), ("void f();", None, True, None, "deleted_or_merged")]
    df = spark.createDataFrame(rows, "d string, h boolean, x boolean, v boolean, want string")
    for r in df.select("want", mapping.item_status(F.col("d"), F.col("h"), F.col("x"), F.col("v")).alias("got")).collect():
        assert r["want"] == r["got"]


def test_history(spark):
    rows = [("k", i, "x" * 10) for i in range(6)]
    d = diagnostics.history_under_budget(spark.createDataFrame(rows, "k string, turn int, body string"), ["k"], "turn", "body", 25, 1)
    assert {r["turn"]: r["dropped"] for r in d.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_json_helpers():
    assert json.loads(text.canonical_json('{"z":[1.5,2.0]}')) == {"z": [1.5, 2]}


def test_declarations():
    from sparkwright.functions import declarations as d

    c = "class A : public B<C> {\npublic:\n  A(int x = 3); // c\n  virtual ~A() = default;\n  static int N;\n  static constexpr int K = 1;\n  virtual std::map<std::string, int> f(const std::vector<int>& a, B* b) const { if (x) { y(); } }\n  bool operator==(const A& o);\n};"
    got = [d.parse_declaration(x) for x in d.members(d.class_body(c, "A"))]
    assert got == [("A", ["int"]), ("~A", []), None, None, ("f", ["std::vector<int>&", "B*"]), ("operator==", ["A&"])]
    assert d.static_definitions(c, "A", "") == ["int A::N;"] and d.static_definitions(c, "A", "int A::N = 2;") == []
    assert d.find_declaration(c, "A", "f", 2) and d.find_declaration(c, "A", "f", 1) is None and d.find_declaration(c, "Absent", "f", 2) is None
    assert d.parse_declaration("std::function<R()> supplier;") is None and d.parse_declaration("template <class T> T f(int a);") == ("f", ["int"])
    assert d.inheritance("/* class Z */ final class Q<T extends R> extends S<T, U> implements V, W<X, Y> {") == ("Q", "S<T, U>", ["V", "W<X, Y>"])
    assert d.map_type("Map<String, ? extends List<T>>", ("T",)) == "std::map<std::string, std::vector<T>>" and d.map_type("int[]...") == "std::vector<std::vector<int>>"
    assert [d.map_type(x) for x in ("long", "Object", "Duration", "a.b.Foo", "?", "byte[][]", "Class<T>", "Foo<? super Bar>")] == ["long long", "void*", "std::chrono::duration<long long, std::nano>", "Foo", "void*", "std::vector<char>", "void*", "Foo<Bar>"]
    assert d.signature_errors("A:f(List<String>,B)", "void f(const std::vector<std::string>& a, B* b);") == [] and len(d.signature_errors("A:f(int)", "void g(std::string s);")) == 2
    assert d.header_errors("class A extends X {}", c) == ["base X missing"] and d.header_errors("class A extends B {}", c) == []
    assert d.parse_function("static void A::g(int x) { }")["owner"] == "A" and d.parse_function("A::A() {", "A")["constructor"]
    assert d.statements('{ for (int i=0;i<3;i++) { a("x;"); } if (b) { return; } }') == 4
    # bodies without braces and switch labels do not count, blocks in them and lambda bodies do
    assert [d.statements(x) for x in ("{ if (a) b(); }", "{ if (a) b(); else { c(); d(); } }", "{ switch (a) { case 1: b(); break; case 2: { c(); } default: } return 1; }", "void f();", "@A(x = {1}) void f() { a(); }", "{ run(() -> { a(); b(); }); int[] c = {1, 2}; do { d(); } while (x); }", "{ try { a(); } catch (E e) { b(); } finally { } l: while (x) { break l; } }")] == [1, 3, 3, 0, 1, 6, 5]


def test_predicates(spark):
    from sparkwright.functions import predicates as p

    assert p.split_filter(" a, b,,a ") == ["a", "b"] and p.split_filter(None) == []
    assert p.job_pairs("3:a, 5:b") == [(3, "a"), (5, "b")]
    with pytest.raises(ValueError):
        p.job_pairs("x:a")
    assert [one(spark, v, p.as_bool) for v in ("TRUE", " yes", "0", None)] == [True, True, False, False]
    assert one(spark, None, lambda c: p.number(c.cast("double"))) == "-"
    df = spark.createDataFrame([("Xy", [1], 3)], "a string, l array<int>, b int")
    kept = lambda text: df.where(p.filter_expression(text)).count()
    assert kept("string.startsWithIC(a, 'xY') && !(b == 4) && include(l, 1)") == 1 and kept("string.endsWith(a, 'Y')") == 0 and kept("b != 3 || string.length(a) > 2") == 0


def test_classes_of_all_phrases_in_both_engines(spark):
    """Every phrase alone and joined with every seventh other: the table and the SQL written by itself give the same class."""
    import duckdb

    from sparkwright.functions import rules
    from sparkwright.plans import class_sql

    phrases = sorted({p.lstrip("^") for _, alts in rules.rule_table() for alt in alts for p in alt})
    texts = phrases + [f"{a} X {b}" for i, a in enumerate(phrases) for b in phrases[i % 7 :: 7]] + ["nothing known", "", "Expected ';'"]
    spark_side = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string").select("i", rules.classify(F.col("m")).alias("c")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("create table t (i int, m varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    other = [r[0] for r in con.execute(f"select {class_sql.classes('m')} from t order by i").fetchall()]
    assert spark_side == other and len(set(other)) == 7


def test_issues_ignore_case(spark):
    from sparkwright.functions import rules

    assert one(spark, "x: Fatal Error: 'Q.h' File not found", rules.issue_types) == ["missing_include"]
    assert one(spark, "UNKNOWN type name 'x'; redefinition of 'y'", rules.issue_types) == ["duplicate_definition", "unknown_type"] and one(spark, "odd", rules.issue_types) == ["compile_error"]
