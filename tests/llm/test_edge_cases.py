"""Nulls, empties, ties, repeated rows, empty tables and extra columns for every query."""

import datetime as dt

import pytest

pytest.importorskip("sparkwright.llm")

from sparkwright.llm import queries  # noqa: E402

NOW = dt.datetime(2025, 1, 1)
CODE = "package a;\n\n/**\n * The reader waits until the other side has closed the stream.\n */\npublic class A {\n    // The reader waits until the other side has closed the stream.\n    void f(int x) { g(\"The buffer is shared between all the open files here.\"); }\n}\n"
SCHEMAS = {
    "headers": "header_id long, source_code string, raw_translated_code string, ai string, record_kind string, body string, id long, rep long",
    "methods": "method_id long, code string, raw_translated_code string, ai string, record_kind string, body string, record_id long",
    "documents": "doc_id long, text string, lang string, source string, body string, n_tokens long, lang_code string",
    "eval_items": "item_id long, suite string, lang string, instruction string, passage string, body string",
    "mixture_targets": "source string, target_share double, max_repeats int, rate double",
    "piece_limits": "record_kind string, max_chars int, overlap_chars int, body string",
}
SENTENCE = "The frame decoder rejects every request that is older than the limit whenever two threads meet here. "
ROWS = {
    "headers": [(1, CODE, "text\n\n```cpp\nvoid f() {", "m", "x", "y", 5, 6), (1, CODE, None, None, None, None, None, None), (2, CODE + "// end", "", "m", "x", "y", 5, 6), (3, None, "Done.", None, None, None, None, None), (4, "", " ", "m", None, None, None, None), (5, " \n", "}", "m", None, None, None, None), (6, "/* open", "[...]", "m", None, None, None, None), (7, "x" * 50_000, "y" * 50_000, "m", None, None, None, None), (None, CODE, "a", "m", None, None, None, None)],
    "methods": [(1, "// Waits until the other side has closed the stream.\nvoid f();", '{"a": 1', "m", "x", "y", 1), (2, None, None, None, None, None, None), (3, "\"\\ud83d", "�", "m", None, None, None), (4, "int x;\r\n" * 900, "ok", "m", None, None, None), (4, "int x;\r\n" * 900, "ok", "m", None, None, None)],
    "documents": [(1, SENTENCE * 3, "en", "Web Pages", "b", 1, "q"), (2, None, "en", "web_pages", None, None, None), (3, "", None, None, None, None, None), (4, "```\nint x;\n```", "de", "none", None, None, None), (5, SENTENCE * 2 + "Der Spaltenleser wartet, bis die Gegenseite geschlossen hat und alles gelesen ist.", "", "web_pages ", None, None, None), (5, SENTENCE, "xx-unknown", "web_pages", None, None, None), (None, SENTENCE, "en", "web_pages", None, None, None), (8, SENTENCE * 900, "fr", "other", None, None, None), (9, "這퟿ \U0001f600", "zh", "web_pages", None, None, None)],
    "eval_items": [(1, "s", "en", "i", SENTENCE, "b"), (2, "s", "en", "i", "too short", None), (3, None, None, None, None, None), (1, "s", "en", "i", SENTENCE, "b"), (None, "s", "en", "i", SENTENCE, None)],
    "mixture_targets": [("web_pages", 0.7, 3, 0.1), ("other", 0.3, 1, None), ("nowhere", None, None, None), (None, 0.5, 1, None), ("web_pages", 0.1, 1, None)],
    "piece_limits": [("headers", 6000, 400, "b"), ("methods", 2000, 150, None), ("methods", 2500, 100, None), ("headers", None, 1, None), (None, 5, 1, None)],
}


def write(spark, table_dir, rows):
    return table_dir(**{n: spark.createDataFrame([tuple(None if isinstance(v, str) and "\ud83d" <= v[-1:] <= "\udfff" else v for v in r) for r in rows[n]], s) for n, s in SCHEMAS.items()})


@pytest.fixture
def dirty(spark, table_dir):
    return write(spark, table_dir, ROWS)


@pytest.fixture
def empty(spark, table_dir):
    return write(spark, table_dir, {n: [] for n in SCHEMAS})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_dirty_tables(spark, dirty, name):
    df = queries.QUERIES[name](spark, dirty)
    rows = df.collect()
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
        assert not any(None in tuple(r) for r in rows)


def test_found_rows(spark, dirty):
    got = {n: {tuple(r) for r in queries.QUERIES[n](spark, dirty).collect()} for n in queries.QUERIES if n.endswith("_found")}
    assert got["p1_found"] == {(1, 2)}
    assert got["p3_found"] == {("headers", 7, "oversized"), ("headers", 7, "no_boundary"), ("methods", 4, "oversized")}
    assert {("headers", 1, "f"), ("headers", 2, "f"), ("methods", 1, "f")} == got["p4_found"]
    # a handful of texts is no model; remarks and broken characters tell without one
    assert {("headers", 6), ("methods", 3)} <= got["p6_found"] and not {("headers", 4), ("methods", 2)} & got["p6_found"]
    assert got["p8_found"] == {(1, 1), (5, 1), (8, 1)}


def test_mixture(spark, dirty):
    shares = {r["source"]: r for r in queries.QUERIES["p9_shares"](spark, dirty).collect()}
    assert set(shares) == {"web_pages", "other", "nowhere"} and shares["nowhere"]["used_tokens"] == 0
    copies = queries.QUERIES["p9_mixture"](spark, dirty).collect()
    assert all(1 <= r["copy_no"] <= shares[r["source"]]["max_repeats"] for r in copies)
    assert {s: sum(r["n_tokens"] for r in copies if r["source"] == s) for s in shares} == {s: r["used_tokens"] for s, r in shares.items()}
