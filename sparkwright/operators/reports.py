"""Reports of test runs, fragments and costs, from recorded outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

# Lines of the test protocol, behind any upper-case prefix.
RESULT, START, COUNT = r"^(?:[A-Z0-9]+_)?TEST_RESULT\t", r"^(?:[A-Z0-9]+_)?TEST_START\t(.*)$", r"\b(?:[A-Z0-9]+_)?TEST_COUNT\D+(\d+)"


def _lines(stdout: Column) -> Column:
    return F.split(F.regexp_replace(stdout, r"\r\n?", "\n"), "\n")


def test_results(runs: DataFrame, key: str = "project", stdout: str = "stdout") -> DataFrame:
    """(key, name, status, message) of each complete result line; lines of fewer than four parts are skipped."""
    parts = F.split("line", "\t", 4)
    x = runs.select(key, F.posexplode(_lines(F.col(stdout))).alias("pos", "line")).where(F.col("line").rlike(RESULT) & (F.size(parts) == 4))
    return x.select(key, (F.col("pos") + 1).alias("line_no"), parts[1].alias("name"), parts[2].alias("status"), parts[3].alias("message"))


def last_started(stdout: Column) -> Column:
    """The last test that began; empty without any."""
    names = F.transform(F.filter(_lines(stdout), lambda x: x.rlike(START)), lambda x: F.trim(F.regexp_extract(x, START, 1)))
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))


def planned_count(source: Column) -> Column:
    """The number of planned tests; a source without it is an error."""
    n = F.regexp_extract(source, COUNT, 1)
    return F.when(n == "", F.raise_error(F.lit("the test source declares no count"))).otherwise(n).cast("int")


def test_reports(runs: DataFrame) -> DataFrame:
    """Status, strict and conditional pass rate per run of (project, planned, stdout, compile_returncode, run_returncode, timed_out).

    Build failures and time-outs count all planned tests as failed; rates of nothing are 0.
    """
    ran = (F.col("compile_returncode") == 0) & ~F.coalesce("timed_out", F.lit(False)) & F.col("run_returncode").isNotNull()
    tests = F.when(ran, F.filter(_lines(F.col("stdout")), lambda x: x.rlike(RESULT) & (F.size(F.split(x, "\t", 4)) == 4))).otherwise(F.array().cast("array<string>"))
    passed = F.size(F.filter("tests", lambda x: F.split(x, "\t", 4)[2] == "PASS"))
    out = runs.withColumn("tests", F.coalesce(tests, F.array().cast("array<string>"))).withColumns({"passed": passed, "executed": F.size("tests")})
    all_ok = (F.col("executed") == F.col("planned")) & (F.col("passed") == F.col("executed")) & (F.col("run_returncode") == 0)
    status = F.when(F.col("compile_returncode") != 0, "test_build_failed").when(F.coalesce("timed_out", F.lit(False)), "timeout").when(F.col("run_returncode").isNull(), "not_run").when(all_ok, "passed").otherwise("test_failed")
    return out.select(
        "project", status.alias("status"), "planned", "executed", "passed", ratio(F.col("passed"), F.col("planned"), 0.0).alias("strict_pass_rate"),
        ratio(F.col("passed"), F.col("executed"), 0.0).alias("conditional_pass_rate"), last_started(F.col("stdout")).alias("last_started_test"), returncode(F.col("run_returncode")).alias("diagnostic"),
    )


def returncode(code: Column) -> Column:
    """A return code's meaning; negative ones are shown as unsigned 32-bit numbers."""
    u = F.pmod(code.cast("long"), F.lit(2**32))
    # Codes of crashes.
    named = F.when(u == 0xC0000005, "access violation").when(u == 0xC00000FD, "stack overflow").when(u == 0xC0000409, "stack buffer overrun").when((code == -11) | (code == 139), "segmentation fault").when((code == -6) | (code == 134), "aborted")
    return F.when(code.isNull(), "").when(code == 0, "").otherwise(F.concat(F.format_string("0x%08X", u), F.coalesce(F.concat(F.lit(" "), named), F.lit(""))))


FLAGS = ("first_syntax_success", "final_syntax_success", "first_compile_success", "final_compile_success")


def fragment_report(fragments: DataFrame) -> DataFrame:
    """Count and LoC rates of four flags for all fragments and by kind, in one pass; a missing flag is false."""
    aggs = [F.count(F.lit(1)).alias("total"), F.sum("source_loc").alias("total_loc"), F.count_if(F.coalesce("stubbed", F.lit(False))).alias("stubs"), F.sum("query_count").alias("queries")]
    for f in FLAGS:
        ok = F.coalesce(f, F.lit(False))
        aggs += [ratio(F.count_if(ok), F.count(F.lit(1)), 0.0).alias(f"{f}_rate"), ratio(F.sum(F.when(ok, F.col("source_loc")).otherwise(0)), F.sum("source_loc"), 0.0).alias(f"{f}_loc_rate")]
    g = fragments.groupingSets([["kind"], []], "kind").agg(*aggs)
    return g.withColumn("kind", F.coalesce("kind", F.lit("all")))


def attempts_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Replay of bounded retries: the first and last attempt's outcome, the attempt that succeeded first, whether the budget was used up."""
    ok = F.coalesce("ok", F.lit(False))
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.coalesce(F.min_by(ok, "attempt"), F.lit(False)).alias("first_ok"), F.coalesce(F.max_by(ok, "attempt"), F.lit(False)).alias("final_ok"), F.min(F.when(ok, F.col("attempt"))).alias("solved_at")
    )


def token_usage(traces: DataFrame, keys: list[str], round_up: bool = False) -> DataFrame:
    """Measured and estimated tokens: rows without usage are estimated from their texts (length / 4), where they have any."""
    size = F.length(F.coalesce("prompt", F.lit(""))) + F.length(F.coalesce("response", F.lit("")))
    est = (F.ceil if round_up else F.floor)(size / 4.0)
    have = F.col("total_tokens").isNotNull()
    return traces.groupBy(*keys).agg(
        F.count_if(have).alias("calls_with_usage"), F.count_if(~have).alias("calls_without_usage"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("measured_tokens"),
        F.coalesce(F.sum(F.when(~have, est)), F.lit(0)).alias("estimated_tokens"), F.round(F.sum("elapsed_seconds"), 3).alias("elapsed_seconds"), F.bool_or(~have & (size > 0)).alias("estimable"),
    )
