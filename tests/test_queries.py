"""Every core query equals its SQL twin, or where it has none what is checked here row by row."""

import re

import pytest

from sparkwright.functions import declarations, text
from sparkwright.operators import diagnostics
from sparkwright.operators.logparse import head
from sparkwright.plans import core_queries, registry
from sparkwright.tables import load

from .oracle import same, views


def key(r):
    return r["project"], r["run_id"]


def table(spark, sf, name, *cols):
    return load(spark, sf, name, *cols).collect()


def p2_hierarchies(spark, sf, rows):
    for r in rows:
        assert r["n_descendants"] == len(set(r["descendants"])) and r["on_cycle"] == (r["node_id"] in r["descendants"])
        assert r["path"] is None or (len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"])


def every_line(spark, sf):
    for r in table(spark, sf, "compile_result", "result_id", "log_output", "recorded_at"):
        yield from (("compile_result", r["result_id"], 0, no, line, r["recorded_at"]) for no, line in enumerate((r["log_output"] or "").split("\n"), 1))
    for r in table(spark, sf, "compile_feedback", "feedback_id", "diagnostic_blocks", "recorded_at"):
        for k, block in enumerate(r["diagnostic_blocks"] or [], 1):
            yield from (("compile_feedback", r["feedback_id"], k, no, line, r["recorded_at"]) for no, line in enumerate((block or "").split("\n"), 1))


def p7_found(spark, sf, rows):
    """Lines parsed each for itself give the same entries."""
    want = set()
    for kind, i, k, no, line, at in every_line(spark, sf):
        if h := head(line, at.year if at else None):
            want.add((kind, i, k, no, h[1], h[0] or "none"))
    assert {(r["record_kind"], r["record_id"], r["block_no"], r["line_no"], r["log_level"], r["entry_time"]) for r in rows} == want and want


def p7_entries(spark, sf, rows):
    found = registry.QUERIES["p7_found"](spark, sf).collect()
    assert {(r["record_kind"], r["record_id"], r["block_no"], r["line_no"]) for r in rows} == {(r["record_kind"], r["record_id"], r["block_no"], r["line_no"]) for r in found}
    assert all(r["n_lines"] == r["message"].count("\n") + 1 for r in rows)


def p7_templates(spark, sf, rows):
    assert sum(r["n_lines"] for r in rows) == sum(1 for *_, k, no, line, at in every_line(spark, sf) if line is not None) - empty_texts(spark, sf)


def empty_texts(spark, sf):
    logs = sum(1 for r in table(spark, sf, "compile_result", "log_output") if not r["log_output"])
    return logs + sum(1 for r in table(spark, sf, "compile_feedback", "diagnostic_blocks") for b in r["diagnostic_blocks"] or [] if not b)


def header_batches(spark, sf, rows):
    want = {(*key(r), r["header_key"].replace("$", "_")) for r in table(spark, sf, "headers", "project", "run_id", "header_key") if r["header_key"]}
    assert sorted((*key(r), r["header_key"]) for r in rows) == sorted(want)
    sizes = {}
    for r in rows:
        sizes.setdefault((*key(r), r["batch_no"]), []).append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 5 for p in sizes.values())


def closed(rows, edges):
    for r in rows:
        names = r["cycle"].split(" > ")
        assert len(set(names)) == r["length"] == len(names) and names[0] == min(names) or names == min(names[i:] + names[:i] for i in range(len(names)))
        assert all((*key(r), a, b) in edges for a, b in zip(names, names[1:] + names[:1]))


def cycles(spark, sf, rows):
    edges = {(*key(r), r["src"], r["dst"]) for r in core_queries.inner(spark, sf).collect()}
    closed(rows, edges)
    on_cycles = {(*key(r), r["node"]) for r in registry.QUERIES["cycle_nodes"](spark, sf).collect()}
    assert {(*key(r), n) for r in rows for n in r["cycle"].split(" > ")} <= on_cycles and bool(rows) == bool(on_cycles)


def import_cycles(spark, sf, rows):
    closed(rows, {(*key(r), r["header_key"], r["target"]) for r in core_queries.import_edges(spark, sf).collect()})


def per_value(name, id_col, column, fn, out):
    def check(spark, sf, rows):
        want = {r[id_col]: fn(r[column]) for r in table(spark, sf, name, id_col, column) if r[column] is not None}
        got = {r[id_col]: r[out] for r in rows}
        assert got and all(got[i] == want[i] for i in got)

    return check


def json_objects(spark, sf, rows):
    replies = {r["method_id"]: r["raw_translated_code"] for r in table(spark, sf, "methods", "method_id", "raw_translated_code") if "{" in (r["raw_translated_code"] or "")}
    assert {r["method_id"] for r in rows} == set(replies)
    for r in rows:
        assert r["object"] is None or text.canonical_json(r["object"]) == r["object"]


def member_declarations(spark, sf, rows):
    code = {r["header_id"]: r["source_code"] for r in table(spark, sf, "headers", "header_id", "source_code")}
    for r in rows:
        assert re.search(re.escape(r["declaration"].split("(")[0]) + r"\s*\(", code[r["header_id"]])


def header_skeletons(spark, sf, rows):
    for r in rows:
        short = r["header_key"].split("$")[-1]
        assert declarations.class_body(r["skeleton"], short) is not None and "void*<" not in r["skeleton"]
    assert any(re.search(r"virtual (?!void)\S+ \w+\(", r["skeleton"]) for r in rows)


def diagnostic_blocks(spark, sf, rows):
    logs = {r["result_id"]: r["log_output"] for r in table(spark, sf, "compile_result", "result_id", "log_output")}
    got = {}
    for r in sorted(rows, key=lambda r: (r["result_id"], r["block_no"])):
        got.setdefault(r["result_id"], []).append(r["block"])
    assert got and all(b == diagnostics.diagnostic_blocks(logs[i]) for i, b in got.items())


def block_scopes(spark, sf, rows):
    assert {r["scope"] for r in rows} <= {"local", "project", "external"} and rows


CHECKS = {
    "p2_hierarchies": p2_hierarchies, "p7_found": p7_found, "p7_entries": p7_entries, "p7_templates": p7_templates, "header_batches": header_batches, "cycles": cycles, "import_cycles": import_cycles,
    "normalized_signatures": per_value("methods", "method_id", "method_key", text.normalize_signature, "signature"), "statement_counts": per_value("methods", "method_id", "code", declarations.statements, "n_statements"),
    "json_objects": json_objects, "member_declarations": member_declarations, "header_skeletons": header_skeletons, "diagnostic_blocks": diagnostic_blocks, "block_scopes": block_scopes,
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLE:
        same(df, views(sf), registry.ORACLE[name])
    else:
        CHECKS[name](spark, sf, df.collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
