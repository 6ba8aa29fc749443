"""Splitting oversized items at natural boundaries, with balanced targets.

The fewest pieces that the limit allows are computed, equal-length targets placed, and each target is
snapped to the strongest boundary near it: the end of a member, then of a block or statement, then of
a line, then white space. Where any piece would pass the limit, a piece is added and all is placed anew.
Where a window holds no boundary at all the text is cut at the limit, never inside a pair of CR and LF.

Lengths are code points. Each piece repeats the last ``overlap_chars`` characters of the one before.
Texts up to the limit, null and empty texts give no pieces. An overlap of at least the limit is reduced to
one less than the limit. Record kinds without a limit give none; of repeated limits the smallest is used.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load, small

PIECE_SCHEMA = (
    "record_kind string, record_id long, piece_no int, n_pieces int, start_char int, end_char int, cut_kind string, "
    "longest_line int, piece string"
)
#: Boundaries by strength: the position after the match is where the text may be cut.
BOUNDARIES = (
    ("member", 4.0, re.compile(r"\n[ \t]*\}[ \t]*;?[ \t]*\r?\n(?:[ \t]*\r?\n)*|\r?\n[ \t]*\r?\n")),
    ("statement", 2.0, re.compile(r"[;{}][ \t]*(?://[^\n]*)?\r?\n")),
    ("line", 1.0, re.compile(r"\n")),
    ("space", 0.2, re.compile(r"(?<=[;,)}\]。、，.])\s*|[ \t]+")),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and strengths (rank in BOUNDARIES, 0 strongest), the strongest of each position."""
    best: dict[int, int] = {}
    for rank in range(len(BOUNDARIES) - 1, -1, -1):
        for m in BOUNDARIES[rank][2].finditer(text):
            best[m.end()] = rank
    best.pop(0, None)
    best.pop(len(text), None)
    pos = np.fromiter(sorted(best), dtype=np.int64, count=len(best))
    return pos, np.fromiter((best[p] for p in pos.tolist()), dtype=np.int64, count=len(best))


def place(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece; starts include the overlap."""
    n = len(text)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, "end")]
    pos, rank = boundaries(text)
    where = pos.tolist()
    fresh = limit - overlap  # new characters of every piece but the first
    count = 1 + -(-(n - limit) // fresh)
    while True:
        share = (n + (count - 1) * overlap) / count  # equal lengths, overlaps counted
        cuts, kinds, last = [], [], 0
        for k in range(1, count):
            begin = max(0, last - overlap) if last else 0
            target = round(k * share - (k - 1) * overlap)
            top = min(begin + limit, n - 1)
            # what is left must still fit in the pieces left, else a later piece passes the limit
            low = max(last + 1, n - (limit + (count - k - 1) * fresh) + overlap if count > k else last + 1)
            reach = max(fresh // 3, 1)
            a, b = bisect_left(where, max(low, target - reach)), bisect_right(where, min(top, target + reach))
            if a >= b:
                a, b = bisect_left(where, max(last + 1, low)), bisect_right(where, top)
            if a < b:
                w = np.array([BOUNDARIES[r][1] for r in rank[a:b]])
                score = w - 1.5 * np.abs(pos[a:b] - target) / max(fresh, 1)
                i = a + int(np.argmax(score))
                cuts.append(where[i])
                kinds.append(BOUNDARIES[rank[i]][0])
            else:
                cut = min(top, max(target, last + 1))
                if text[cut - 1 : cut + 1] == "\r\n" and cut - 1 > last:
                    cut -= 1
                cuts.append(cut)
                kinds.append("hard")
            last = cuts[-1]
        starts = [0, *(max(0, c - overlap) for c in cuts)]
        ends = [*cuts, n]
        if all(e - s <= limit for s, e in zip(starts, ends)):
            return list(zip(starts, ends, [*kinds, "end"]))
        count += 1


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["record_kind", "record_id", "piece_no", "n_pieces", "start_char", "end_char", "cut_kind", "longest_line", "piece"]
    for pdf in batches:
        rows = []
        for kind, rid, text, limit, overlap in zip(pdf["record_kind"], pdf["record_id"], pdf["body"], pdf["max_chars"], pdf["overlap_chars"]):
            longest = max(map(len, text.split("\n")))
            pieces = place(text, int(limit), int(overlap))
            for no, (s, e, cut) in enumerate(pieces, 1):
                rows.append((kind, rid, no, len(pieces), s, e, cut, longest, text[s:e]))
        out = pd.DataFrame(rows, columns=cols)
        yield out.astype({c: "int32" for c in ("piece_no", "n_pieces", "start_char", "end_char", "longest_line")} | {"record_id": "int64"})


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of ``items`` (record_kind, record_id, body) above their limit in ``limits``.

    Short texts are dropped in the JVM; only oversized ones reach Python. ``limits`` is one row per record
    kind, counted before it is broadcast.
    """
    lim = limits.where("max_chars > 0").groupBy("record_kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    big = items.join(small(lim), "record_kind").where(F.length("body") > F.col("max_chars"))
    return big.select("record_kind", "record_id", "body", "max_chars", "overlap_chars").mapInPandas(_split_batches, PIECE_SCHEMA)


def code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "headers", "header_id", "source_code")
    m = load(spark, sf_dir, "methods", "method_id", "code")
    return h.select(F.lit("headers").alias("record_kind"), F.col("header_id").alias("record_id"), F.col("source_code").alias("body")).union(
        m.select(F.lit("methods").alias("record_kind"), F.col("method_id").alias("record_id"), F.col("code").alias("body"))
    )


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(code_items(spark, sf_dir), load(spark, sf_dir, "piece_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = load(spark, sf_dir, "piece_limits").groupBy("record_kind").agg(F.min("max_chars").alias("max_chars"))
    whole = p3_pieces(spark, sf_dir).where("piece_no = 1").select("record_kind", "record_id", "longest_line").join(small(limits), "record_kind")
    cases = F.when(F.col("longest_line") > F.col("max_chars"), F.array(F.lit("oversized"), F.lit("no_boundary"))).otherwise(F.array(F.lit("oversized")))
    return whole.select("record_kind", "record_id", F.explode(cases).alias("case_kind")).distinct()


def p3_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cut record whether its pieces, laid end to end without what they repeat, are the text, and whether each keeps to limit and overlap."""
    lim = load(spark, sf_dir, "piece_limits").where("max_chars > 0").groupBy("record_kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    p = p3_pieces(spark, sf_dir).dropDuplicates(["record_kind", "record_id", "piece_no"]).join(small(lim), "record_kind")
    length, first = F.length("piece"), F.col("piece_no") == 1
    # what a piece repeats ends where the piece before it ends: sums of starts and ends over a record tell without looking back
    own = F.when(first, length).otherwise(length - F.col("overlap_chars"))
    g = p.groupBy("record_kind", "record_id").agg(F.sum(own).alias("n_chars"), F.bool_and(length <= F.col("max_chars")).alias("within_limit"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("complete"), F.bool_and(F.col("end_char") - F.col("start_char") == length).alias("placed"))
    return g.select("record_kind", "record_id", "n_chars", (F.col("within_limit") & F.col("complete") & F.col("placed")).alias("sound"))
