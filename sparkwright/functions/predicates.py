"""Row predicates and small parsers of options. Nulls: a predicate is false where its inputs are missing, unless it says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c), F.lit("")) != ""


def as_bool(c: Column) -> Column:
    """1, true and yes in any case are true, all else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def is_generated(source_kind: Column, kind: Column) -> Column:
    return F.coalesce((source_kind == "generated_external") | (kind == "generated_external"), F.lit(False))


def is_stub(source_kind: Column) -> Column:
    return F.coalesce(source_kind == "manual_stub", F.lit(False))


def is_source(source_kind: Column, kind: Column) -> Column:
    return ~is_generated(source_kind, kind) & ~is_stub(source_kind)


def valid_run(returncode: Column, completed: Column, *needed: Column) -> Column:
    """Ended well, completed, and nothing that is needed is missing."""
    ok = F.coalesce((returncode == 0) & completed, F.lit(False))
    for c in needed:
        ok = ok & c.isNotNull()
    return ok


# Marks of failed model calls in a log.
PROVIDER_ERRORS = ("rate limit", "insufficient balance", "invalid api key", "connection error", "503 service unavailable", "authentication")


def resumable(valid: Column, log: Column) -> Column:
    """A valid row whose log shows no failed model call."""
    low = F.lower(F.coalesce(log, F.lit("")))
    bad = F.lit(False)
    for mark in PROVIDER_ERRORS:
        bad = bad | low.contains(mark)
    return valid & ~bad


def retry_warnings(warnings: Column) -> Column:
    """Whether a list of warnings holds one that calls for another try."""
    return F.coalesce(F.exists(warnings, lambda w: F.coalesce(w.startswith("missing mapping") | w.startswith("duplicate mapping") | w.startswith("invalid definition"), F.lit(False))), F.lit(False))


def concrete_body(code: Column) -> Column:
    """A declaration with braces that is not abstract."""
    return F.coalesce(code.contains("{") & ~code.rlike(r"^\s*(?:@\w+\s*)*(?:[\w<>\[\], ]+\s)?abstract\s"), F.lit(False))


def pending_method(kind: Column, skipped: Column, deleted: Column, location: Column, done: Column) -> Column:
    """Work left: no interface, not skipped or deleted, with a place for its body, not done."""
    return (F.coalesce(kind, F.lit("")) != "interface") & ~F.coalesce(skipped, F.lit(False)) & ~F.coalesce(deleted, F.lit(False)) & filled(location) & ~F.coalesce(done, F.lit(False))


def production_source(path: Column, content: Column) -> Column:
    """Files that belong to the product: no names with two leading underscores, no entry point."""
    return ~path.rlike(r"(?:^|/)__[^/]*$") & ~F.coalesce(content, F.lit("")).rlike(r"\bint\s+main\s*\(")


def all_compiled(functions: Column) -> Column:
    """Every function of a record has a result; true without functions."""
    return F.forall(functions, lambda f: f["success"].isNotNull())


def looks_like_method(code: Column, name: Column) -> Column:
    """Whether a text holds the method that is asked for, with a body."""
    return F.coalesce(code.contains(name) & code.contains("(") & code.contains("{") & code.contains("}"), F.lit(False))


def labels(c: Column, names: dict[str, str], default: str = "Unknown") -> Column:
    """Dimension labels by a small map."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(c, F.lit(""))), F.lit(default))


def number(c: Column, form: str = "%.2f", missing: str = "-") -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.format_string(form, c)), F.lit(missing))


def split_filter(value: str | None) -> list[str]:
    """A comma list without blanks and repetitions, in order."""
    return list(dict.fromkeys(x.strip() for x in (value or "").split(",") if x.strip()))


def job_pairs(value: str) -> list[tuple[int, str]]:
    """``batch:project`` pairs of a comma list."""
    out = []
    for part in split_filter(value):
        m = re.fullmatch(r"(\d+):(\S+)", part)
        if not m or int(m[1]) < 1:
            raise ValueError(f"not batch:project: {part}")
        out.append((int(m[1]), m[2]))
    return out


# Word comparisons of the filter language of call-graph tools.
_WORDS = {"startsWith": "startswith", "endsWith": "endswith", "contains": "contains"}
_CALL = re.compile(r"string\.(startsWith|endsWith|contains|length)(IC)?\(([^()]*)\)|include\(\s*(\w+)\s*,\s*(\w+)\s*\)")


def filter_expression(text: str) -> str:
    """A filter of the call-graph tools' language as a SQL condition: && || ! == != and the string functions, IC ignoring case."""

    def call(m: re.Match) -> str:
        if m[4]:
            return f"array_contains({m[4]}, {m[5]})"
        args = [a.strip() for a in m[3].split(",")]
        if m[1] == "length":
            return f"length({args[0]})"
        a, b = (f"lower({x})" for x in args[:2]) if m[2] else args[:2]
        return f"{_WORDS[m[1]]}({a}, {b})"

    quoted: list[str] = []

    def hold(m: re.Match) -> str:
        quoted.append("'" + m[0][1:-1].replace("'", "\\'") + "'")
        return f"\u0001{len(quoted) - 1}\u0001"

    s = re.sub(r"'[^']*'|\"[^\"]*\"", hold, text)
    s = _CALL.sub(call, s)
    s = re.sub(r"!(?!=)", " NOT ", s).replace("&&", " AND ").replace("||", " OR ").replace("==", "=")
    return re.sub("\u0001(\\d+)\u0001", lambda m: quoted[int(m[1])], s)
