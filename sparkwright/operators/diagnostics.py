"""Compiler diagnostics: blocks of a log, whose file they concern, compaction, feedback of a header.

Block building keeps state over lines, so it runs over Arrow batches of whole logs; everything after it is expressions.
Null logs give no blocks; a log without any error is one block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Include lines remembered before a block, and kept within one.
REMEMBERED, KEPT = 3, 2
MAX_LOG_CHARS = 12_000
_INCLUDED = "In file included from"
_AT = re.compile(r"([^\s:][^:]*):(\d+):(\d+):\s*(?:fatal error|error|warning|note)?")
_ERROR = re.compile(r"(?:fatal )?error:")


def diagnostic_blocks(log: str) -> list[str]:
    """Each error with its lines. Remembered include lines carry over from block to block; a block keeps two of them."""
    found: list[list[str]] = []
    memory: list[str] = []
    for line in log.splitlines():
        bare = line.strip()
        if bare.startswith(_INCLUDED):
            memory = [*memory, line][-REMEMBERED:]
        starts = bool(bare) and not bare.startswith(_INCLUDED) and (" error:" in line or bare.startswith("error:") or " fatal error:" in line)
        if starts:
            found.append([*memory, line])
        elif found:
            found[-1].append(line)
    if not found:
        return [log] if log.splitlines() else []
    out = []
    for block in found:
        kept, n = [], 0
        for line in block:
            n += _INCLUDED in line
            if _INCLUDED not in line or n <= KEPT:
                kept.append(line.rstrip())
        out.append("\n".join(kept).strip())
    return out


def norm(path: str) -> str:
    return re.sub(r"^(?:\./)+", "", path.replace("\\", "/")).lower()


def resolve_location(block: str, owned: set[str]) -> tuple[str, int, int] | None:
    """The error's place; if that is foreign, the first owned place of the notes below, else the nearest of the includes above."""
    lines = block.splitlines()
    at = next((i for i, x in enumerate(lines) if _ERROR.search(x)), None)
    if at is None:
        return None
    place = lambda x: (m[1].strip(), int(m[2]), int(m[3])) if (m := _AT.search(x)) else None
    first = place(lines[at])
    if first is None or not owned or norm(first[0]) in owned:
        return first
    for line in [*lines[at + 1 :], *reversed(lines[:at])]:
        got = place(line) or ((m[1], int(m[2]), 0) if (m := re.search(r"from ([^\s:]+):(\d+)", line)) else None)
        if got and norm(got[0]) in owned:
            return got
    return first


def scope(block: str, header: str, owned: set[str]) -> str:
    """local, project or external: whose file a block concerns; relative paths are matched by their last part."""
    header, others = norm(header), {norm(o) for o in owned} - {norm(header)}
    name = lambda p: p.rsplit("/", 1)[-1]
    got = resolve_location(block, {*others, header})
    if got:
        path = norm(got[0])
        if path == header:
            return "local"
        if path in others:
            return "project"
        if not path.startswith("/") and not re.match(r"[a-z]:", path):
            return "local" if name(path) == name(header) else "project" if name(path) in {name(o) for o in others} else "external"
        return "external"
    line = next((x for x in block.splitlines() if _ERROR.search(x)), "").lower()
    return "local" if name(header) in line else "project" if any(name(o) in line for o in others) else "external"


BLOCKS = "result_id long, block_no int, block string"


def _block_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r, i, b) for r, log in zip(pdf["result_id"], pdf["log_output"]) for i, b in enumerate(diagnostic_blocks(log), 1)]
        yield pd.DataFrame(rows, columns=["result_id", "block_no", "block"]).astype({"result_id": "int64", "block_no": "int32"})


def extract_blocks(logs: DataFrame) -> DataFrame:
    """``BLOCKS`` of (result_id, log_output)."""
    return logs.where("log_output is not null and log_output <> ''").select("result_id", "log_output").mapInPandas(_block_batches, BLOCKS)


SCOPED = "result_id long, block_no int, scope string, file_path string, line_no int, col_no int"


def scoped_blocks(blocks: DataFrame) -> DataFrame:
    """``SCOPED`` of (result_id, block_no, block, file_name, owned array): ``owned`` holds the run's files that the block names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, no, block, name, owned in zip(pdf["result_id"], pdf["block_no"], pdf["block"], pdf["file_name"], pdf["owned"]):
                known = {norm(x) for x in (owned if owned is not None else []) if x}
                at = resolve_location(block, known) or ("", 0, 0)
                rows.append((r, no, scope(block, name or "", known), *at))
            yield pd.DataFrame(rows, columns=["result_id", "block_no", "scope", "file_path", "line_no", "col_no"]).astype({"result_id": "int64", "block_no": "int32", "line_no": "int32", "col_no": "int32"})

    return blocks.select("result_id", "block_no", "block", "file_name", "owned").mapInPandas(run, SCOPED)


def compact_log(c: Column, limit: int = MAX_LOG_CHARS) -> Column:
    """Long logs lose their include lines, then what passes the limit."""
    lines = F.filter(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: ~(x.contains(_INCLUDED) & ~x.contains("error:")))
    short = F.array_join(lines, "\n")
    return F.when(F.length(c) <= limit, c).otherwise(F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("\n...[truncated]"))).otherwise(short))


def compact_detail(c: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("..."))).otherwise(s)


def truncate(c: Column, limit: int, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit(marker))).otherwise(c)


def cap_context(c: Column, lines: int, chars: int, marker: str = "\n...[truncated]") -> Column:
    """The first ``lines`` lines, of them at most ``chars`` characters; what is cut is marked."""
    parts = F.split(c, "\n")
    head = F.array_join(F.slice(parts, 1, lines), "\n")
    return F.when(F.length(head) > chars, F.concat(F.rtrim(F.substring(head, 1, chars)), F.lit(marker))).when(F.size(parts) > lines, F.concat(head, F.lit(marker))).otherwise(head)


def summarize(blocks: Column, n: int) -> Column:
    """The first ``n`` elements joined, with a note on how many are left out."""
    more = F.size(blocks) - n
    return F.concat(F.array_join(F.slice(blocks, 1, n), "\n\n"), F.when(more > 0, F.concat(F.lit("\n... "), more.cast("string"), F.lit(" more"))).otherwise(""))


def history_under_budget(df: DataFrame, keys: list[str], turn: str, text: str, budget: int = 240_000, keep_last: int = 4) -> DataFrame:
    """Turns that fit a budget counted from the newest; the last ``keep_last`` always stay, older ones beyond it are marked dropped."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(turn))
    used = F.sum(F.length(F.coalesce(text, F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("dropped", (F.row_number().over(w) > keep_last) & (used > budget))
