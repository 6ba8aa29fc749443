import datetime as dt

from pyspark.sql import functions as F

from sparkwright.operators.logparse import TOKEN, clean, head, layout, log_lines, mask, p7_entries, p7_found, parse_heads, parse_logs, template_tree


def first(line, year=2025):
    h = head(line, year)
    return h and (h[0], h[1], h[2])


def test_forms():
    t = "2025-06-30 21:00:37"
    assert first("2025-06-30 21:00:37,941 Error [main] linker - symbol X not found") == (t, "error", "linker")
    assert first("2025-06-30T23:00:37.9+0200 [WARN] header.step: x") == (t, "warn", "header.step")
    assert first("2025-06-30T15:30:37-05:30 [Info] ccwrap: x") == (t, "info", "ccwrap")
    assert first("[30/Jun/2025:21:00:37 +0000] cmake SEVERE: x") == (t, "error", "cmake")
    assert first("[1751317237056] FATAL (repair-agent) x") == (t, "fatal", "repair-agent")
    assert first('{"msg": "level: error", "level": "fine", "ts": 1751317237, "logger": "b"}') == (t, "debug", "b")
    assert first('time=2025-06-30T21:00:37Z level=notice component=cmake msg="a \\"b\\""') == (t, "info", "cmake")
    assert first("Jun 30 21:00:37 box4 repair-agent[10136]: debug: x") == (t, "debug", "repair-agent")
    assert first("W0630 21:00:37.407490 18357 batcher.cc:665] x") == (t, "warn", "batcher")
    assert first("2025年6月30日 21:00:37 【错误】ccwrap：x") == (t, "error", "ccwrap")
    assert first("src/A.cpp:382:33: \x1b[1;31merror: \x1b[0mx") == (None, "error", "src/A.cpp:382:33")
    assert first("./A.h:1:2: fatal error: 'B.h' file not found")[1] == "fatal"
    assert first("  linker: CRITICAL: x") == (None, "fatal", "linker")
    assert first("clang++: warning: x")[1] == "warn"
    assert first("src/A.h:1:2: note: previous definition is here")[1] == "note"


def test_continuations():
    for line in ("In file included from src/A.cpp:4:", "                 from src/B.h:26:", '  880 |     log("error: saddle");', "      |   ^~~", "17 errors generated.", "[3/22] Building CXX object a.o", "--------", "Traceback (most recent call last):", '  File "/a.py", line 94, in f', "\tat com.b.C.d(E.java:1)", "Caused by: com.b.X: y", "com.b.XException: y", "    > quoted: INFO x since 2019-01-03", "", "    wafer = 189"):
        assert head(line, 2025) is None, line


def blocks(spark, texts, year=2025):
    return spark.createDataFrame([("r", i, 0, t, year) for i, t in enumerate(texts)], "record_kind string, record_id long, block_no int, body string, yr int")


def test_entries(spark):
    text = "start\n2025-01-01 00:00:00 INFO [main] a - x\n  more\nb: error: y\r\n17 errors generated."
    got = {r["line_no"]: r for r in parse_logs(spark, blocks(spark, [text, None, ""])).collect()}
    assert {k: (r["log_level"], r["n_lines"]) for k, r in got.items()} == {2: ("info", 2), 4: ("error", 2)}
    assert got[2]["message"] == "x\n  more" and got[4]["message"] == "y\n17 errors generated."
    assert head("Feb 30 10:00:00 h a: info: x", 2025)[0] is None
    assert head("Feb 3 10:00:00 h a: info: x", None)[0] is None


LINES = [
    "2024-01-01 10:00:00: error: use of undeclared identifier x in this scope",
    "a.cpp:1:2: y: error: use of undeclared identifier x in this scope",
    "a.cpp:1:2 error: use of undeclared identifier x in this scope",
    "ERROR: wArn: bar baz qux",
    "ERROR: mEow: bar baz qux",
    '{"level": "warn", "msg": "a \\"b\\" c", "ts": 1751317237}',
    '{"level": "odd", "msg": "a", "ts": 1751317237}',
    "W0630 21:00:37.407490 18357 batcher.cc:665] x",
    "time=2025-06-30T21:00:37Z level=notice component=cmake msg=abc",
    "Jun 30 21:00:37 box4 repair-agent[10136]: debug: l'index d'entrées",
    """it's: "don't" 'a' "b": 'c': x/y "z""w": 1""",
    "2025-13-77 21:00:37 INFO [main] a - no such day",
]


def test_fields_do_not_depend_on_other_lines(spark):
    """Every line gives alone what it gives among all others, in any order."""
    def found(texts):
        heads = parse_heads(spark, log_lines(spark, blocks(spark, texts)))
        return {texts[r["record_id"]]: (r["entry_time"], r["log_level"], r["component"], r["message"]) for r in heads.collect()}

    together = found(LINES)
    assert together == found(LINES[::-1])
    assert together == {x: h for x in LINES if (h := head(x, 2025))}
    assert together[LINES[0]][0] == "2024-01-01 10:00:00" and together[LINES[3]][1] == "warn" and together[LINES[4]][1] == "error" and LINES[6] not in together


def test_shapes_keep_tokens(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").select(clean(F.col("line")).alias("t")).select("t", mask(F.col("t")).alias("shape")).collect()
    for r in rows:
        assert len(TOKEN.findall(r["t"])) == len(TOKEN.findall(r["shape"])), r
        assert (layout(r["t"]) is None) == (head(r["t"], 2025) is None) or "odd" in r["t"]


def test_templates_tell_components_from_messages(spark):
    """A word behind the level is a component where few words stand there, else it begins the message."""
    few = [f"2025-01-01 00:00:{i % 60:02d} INFO {'store cache'.split()[i % 2]} opened file {i}" for i in range(60)]
    many = [f"2025-01-01 00:00:{i % 60:02d} WARN {chr(97 + i % 26)}{chr(97 + i // 26)}x is not known here today" for i in range(60)]
    heads = parse_heads(spark, log_lines(spark, blocks(spark, few + many))).collect()
    assert {r["component"] for r in heads if r["log_level"] == "info"} == {"store", "cache"}
    warned = [r for r in heads if r["log_level"] == "warn"]
    assert len(warned) == 60 and all(r["component"] is None and r["message"].endswith("is not known here today") for r in warned)
    shapes, layouts = template_tree(spark, log_lines(spark, blocks(spark, few + many)))
    assert layouts.where("template like '%<*>%'").agg(F.sum("n")).first()[0] == 60 and shapes.count() > layouts.count()


def test_edge_cases(spark, table_dir):
    now = dt.datetime(2024, 12, 31)
    r = spark.createDataFrame([(1, "a: info: x", now, 5), (2, None, now, 5), (3, "", None, 5), (4, "Mar  1 00:00:00 h p[1]: err: x", None, 5), (4, "Mar  1 00:00:00 h p[1]: err: x", now, 5)], "result_id long, log_output string, recorded_at timestamp, level int")
    f = spark.createDataFrame([(1, None, now), (2, [], now), (3, [None, "", "x: warning: y"], now)], "feedback_id long, diagnostic_blocks array<string>, recorded_at timestamp")
    got = {tuple(x) for x in p7_found(spark, table_dir(compile_result=r, compile_feedback=f)).collect()}
    assert got == {("compile_result", 1, 0, 1, "info", "none"), ("compile_result", 4, 0, 1, "error", "none"), ("compile_result", 4, 0, 1, "error", "2024-03-01 00:00:00"), ("compile_feedback", 3, 3, 1, "warn", "none")}
    assert p7_entries(spark, table_dir(compile_result=r.limit(0), compile_feedback=f.limit(0))).count() == 0


def test_year_is_utc(spark, table_dir):
    r = spark.createDataFrame([(1, "Jan  1 00:10:00 h p[1]: err: x", "2025-01-01 00:30:00")], "result_id long, log_output string, t string").selectExpr("result_id", "log_output", "to_timestamp(t) as recorded_at")
    f = spark.createDataFrame([], "feedback_id long, diagnostic_blocks array<string>, recorded_at timestamp")
    d = table_dir(compile_result=r, compile_feedback=f)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert p7_found(spark, d).first()["entry_time"] == "2025-01-01 00:10:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
