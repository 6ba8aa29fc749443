"""Text cut off by field limits, by a backward character n-gram model.

The model reads a text's final context backward, from the last character, behind a symbol for what is
still open there (a code fence, a block, an object, an inline quotation). For each context it knows how
often texts end in it and how often they go on, backed off from long to short contexts. A text's log-odds
of ending against going on are thresholded per language and column; the thresholds come from the
log-odds of all texts. Remarks about the cut and broken characters are taken off first and count as
evidence. The model's counts, scores, thresholds and shares cover all rows, and every place of every text counts as one
where it goes on: first the contexts in which texts end are collected, as no others are ever asked for, then each task
counts how often these stand at the places of its texts, and the counts are added up. Contexts are found by hashes of 64 bits.
Contexts that less than ``SUPPORT`` of a column's texts bear are left to their shorter ones. As all contexts
together bear at most ORDER + 1 times the mass of ends and twentieths of places, this also bounds the model's size.

Null, empty and blank texts are neither cut nor complete: they are left out of the found rows and of the
denominators. Repeated rows count each. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Stage, load

#: Longest context.
ORDER = 9
#: The least support of a context: a share of the column's texts, and a number of texts.
SUPPORT, LEAST_SUPPORT = 5e-4, 4.0
#: Contexts that a task holds before it hands on its ends; characters whose places are counted at once.
HELD_CONTEXTS, HELD_CHARS = 300_000, 1_000_000
#: Between these log-odds the threshold is searched; where a column has no valley it is their middle.
LOWEST, HIGHEST = -5.0, -2.0
#: Weight of the shorter context's estimate, in texts.
WEIGHT = 25.0
#: How far above its threshold a text is still looked at by the exact check.
NEAR = 1.0
#: What a remark about a cut or a broken character at the end takes off the log-odds.
REMARK = 3.0
_REMARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|[a-z ]*(?:closed|truncat|cut|abort|interrupt|end of stream|snip)[a-z ]*)\s*\]|<\s*[a-z /]*(?:truncat|cut|abort|snip|eof)[a-z ]*>|\(\s*[a-z ]*(?:truncat|cut off|abort)[a-z ]*\)|�+)\s*$", re.I)
_LONE = re.compile("[\ud800-\udfff\x00-\x08\x0b\x0e-\x1f]+$")
_QUOTED = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'')
_OBJECT = re.compile(r'[\[{]\s*(?:[\[{]\s*)*"')
# Frequent words of languages that share the Latin script.
LATIN_WORDS = {
    "en": "the and is of to that not for with after before",
    "de": "der die das und nicht ist wird mit nach sich wenn",
    "fr": "le la les et des est une pas pour que dans",
    "es": "el los las y del una por que para con más",
    "pt": "o os as e do da uma não para com que",
}
_LATIN = {w: k for k, ws in LATIN_WORDS.items() for w in ws.split()}
_WORDS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_IF, _ENDIF = re.compile(r"(?m)^\s*#\s*if"), re.compile(r"(?m)^\s*#\s*endif")


def language(text: str) -> str:
    """The language of a text's prose, roughly; for choosing a threshold only."""
    if not text.isascii():
        if re.search("[぀-ヿ]", text):
            return "ja"
        if re.search("[一-鿿]", text):
            return "zh"
        if re.search("[А-я]", text):
            return "ru"
    votes: dict[str, int] = {}
    for w in _WORDS.findall(text):
        if k := _LATIN.get(w.lower()):
            votes[k] = votes.get(k, 0) + 1
    return max(sorted(votes), key=votes.get) if votes else "code"


def state(s: str) -> str:
    """What is open at the end of ``s``."""
    if _OBJECT.match(s):
        try:
            json.loads(s, strict=False)
            return "J0"
        except ValueError:
            return "J1"
    n = s.count("```")
    if n % 2:
        return "F"
    if n:
        tail = s[s.rfind("```") + 3 :].strip()
        if not tail:
            return "E"
        line = tail[tail.rfind("\n") + 1 :]
        if line.startswith(("- ", "* ")):
            return f"L{min(line.count('`'), 4)}{'>' in line:d}"
        return f"T{line.count('`') % 2}"
    if "{" in s or s.startswith("#"):
        bare = _QUOTED.sub("", s) if '"' in s or "'" in s else s
        opened = bare.count("{") - bare.count("}")
        guard = len(_IF.findall(s)) - len(_ENDIF.findall(s))
        return f"C{opened > 0:d}{guard > 0:d}"
    return f"P{s.count('`') % 2}"


#: States in which something is open, and in which nothing can follow.
OPEN, CLOSED = ("F", "J1", "C10", "C11", "C01", "T1", "P1"), ("E", "J0")


def natural(s: str, st: str) -> bool:
    """An end after which nothing need follow: the exact check of what the model suspects."""
    if st in CLOSED or st == "L41":
        return True
    if st in OPEN:
        return False
    line = s[s.rfind("\n") + 1 :].strip()
    if st[0] == "C":
        return line.endswith(("}", "};")) or line.startswith(("#endif", "//"))
    # an ellipsis may end a text or stand for what was cut: the model decides
    return st[0] in "TP" and not line.endswith("...") and line.endswith((".", "。", "!", "！", "?", "？", ":", "：", "`"))


def final(text: str) -> tuple[str, bool]:
    """The text without trailing white space, remarks about a cut and broken characters; whether there were such."""
    s, marked = text.rstrip(), False
    while True:
        # both search the whole text, so only where its last character allows them
        t = _REMARK.sub("", s) if s[-1:] in ("]", ">", ")", "\ufffd") else s
        t = (_LONE.sub("", t) if t and (t[-1] < " " or "\ud800" <= t[-1] <= "\udfff") else t).rstrip()
        if t == s:
            break
        s, marked = t, True
    if s.endswith("…"):
        s = s[:-1].rstrip() + "..."
    return s, marked


def contexts(s: str) -> list[str]:
    """Contexts read backward, the shortest first."""
    st = state(s)
    tail = _DIGIT.sub("0", "".join(c.lower()[0] for c in s[-ORDER:]))  # character by character, as a sigma's lower case depends on its neighbours
    return [st + "|" + tail[len(tail) - k :] for k in range(len(tail) + 1)]


#: All states, numbered.
STATES = ("F", "E", "J0", "J1", *(f"L{k}{q}" for k in range(5) for q in range(2)), "T0", "T1", "C00", "C01", "C10", "C11", "P0", "P1")
_NO = {s: i for i, s in enumerate(STATES)}


def prefix_states(s: str, codes: np.ndarray) -> np.ndarray:
    """The number of ``state(s[:k])`` at each k, for the prefixes that do not end in white space; ``codes`` are the characters of ``s``."""
    n = len(codes)
    ticks = np.concatenate(([0], np.cumsum(codes == 96)))
    fences = [m.end() for m in re.finditer("```", s)]
    first = fences[0] if fences else n + 1  # from here on there is a fence
    out = (_NO["P0"] + ticks % 2).astype(np.uint8)
    brace = s.find("{")
    block = 0 if s.startswith("#") else brace + 1 if brace >= 0 else first
    if block < first:
        change = np.zeros(n + 2, np.int64)
        change[1 : n + 1] = (codes == 123).astype(np.int64) - (codes == 125)

        def quoted(low: int, high: int) -> int:
            """Takes the braces in quotations off where these close; within one that is not closed yet, only inner ones are."""
            off = 0
            for m in _QUOTED.finditer(s, low, high):
                i, e = m.span()
                if "{" in m[0] or "}" in m[0]:
                    inner, held = quoted(i + 1, e - 1), m[0].count("{") - m[0].count("}")
                    change[e] -= held + inner
                    off -= held
            return off

        quoted(0, min(n, first))
        guard = np.zeros(n + 2, np.int64)
        for rule, by in ((_IF, 1), (_ENDIF, -1)):
            for m in rule.finditer(s):
                guard[m.end()] += by
        c = _NO["C00"] + 2 * (np.cumsum(change) > 0) + (np.cumsum(guard) > 0)
        out[block:first] = c[block : min(first, n + 1)]
    for k, a in enumerate(fences):
        b = fences[k + 1] if k + 1 < len(fences) else n + 1
        if k % 2 == 0:
            out[a:b] = _NO["F"]
            continue
        # behind a closed fence, whose last signs may be more than three
        while a < n and s[a] == "`" and a + 1 < b:
            out[a] = _NO["E"]
            a += 1
        out[a:b] = _NO["E"]
        q = a
        while q < n and s[q].isspace():
            q += 1
        while q + 1 < b and q < n:
            end = s.find("\n", q)
            stop = min(b, n + 1 if end < 0 else end + 1)  # prefixes of this line are shorter than this
            t = ticks[q + 1 : stop] - ticks[q]
            if s.startswith(("- ", "* "), q):
                arrow = s.find(">", q)
                out[q + 1 : stop] = _NO["L00"] + 2 * np.minimum(t, 4) + (np.arange(q + 1, stop) > arrow if arrow >= 0 else 0)
                out[q + 1 : min(q + 3, stop)] = _NO["T0"]
            else:
                out[q + 1 : stop] = _NO["T0"] + t % 2
            q = stop
    m = _OBJECT.match(s)
    if m:
        out[m.end() :] = _NO["J1"]
        try:
            out[json.JSONDecoder(strict=False).raw_decode(s)[1]] = _NO["J0"]
        except ValueError:
            pass
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of all characters: as contexts hold them, and whether they are white space."""
    every = [chr(c) for c in range(0x110000)]
    return np.array([48 if c.isdecimal() else ord(c.lower()[0]) for c in every], np.uint64), np.array([c.isspace() for c in every])


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


_FACTOR, _ALL = 0x9E3779B97F4A7C15, 2**64 - 1


@cache
def _seed(kind: str, st: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{st}".encode("utf-8", "surrogatepass"))


@cache
def _seeds(kind: str) -> np.ndarray:
    return np.array([_seed(kind, st) for st in STATES], np.uint64)


def context_hash(kind: str, context: str) -> int:
    """As ``Places`` computes it: from the state, then character by character backward."""
    st, _, tail = context.partition("|")
    h = _seed(kind, st)
    for c in reversed(tail):
        h = ((h ^ (ord(c) + 1)) * _FACTOR) & _ALL
        h ^= h >> 32
    return h


class Places:
    """How often each of some contexts, given by hashes, stands at a place where a text goes on."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.counts = np.zeros(len(self.hashes), np.int64)
        bits = max(int(len(self.hashes)).bit_length() + 5, 8)
        self.shift = np.uint64(64 - bits)
        slots = (self.hashes >> self.shift).view(np.int64)
        # hashes by slot; the few that share one are searched for
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[slots] = np.arange(len(slots), dtype=np.int32)
        self.shared = np.zeros(1 << bits, bool)
        self.shared[slots[1:][slots[1:] == slots[:-1]]] = True
        self.held: list[tuple] = []
        self.n = 0

    def add(self, kind: str, text: str) -> None:
        s = final(text)[0]
        if len(s) > 1:
            codes = _codes(s)
            # the places up to the next visible character have one context, the last character is the end
            at = np.flatnonzero(~_tables()[1][codes])
            weight, states = np.diff(at), prefix_states(s, codes)
            start, at = at[0], at[:-1]
            states = states[at + 1]
            if start:  # only white space so far: its first character stands for it
                at, weight = np.concatenate(([0], at)), np.concatenate(([start], weight))
                states = np.concatenate(([_NO[state(s[:1])]], states))
            self.held.append((kind, codes, at, weight, states))
            self.n += len(codes)
            if self.n > HELD_CHARS:
                self.flush()

    def flush(self) -> None:
        """Counts what is held, context by context from the shortest; a longer one is looked for only where the shorter one is known."""
        if not self.held:
            return
        starts = np.cumsum([0] + [len(x[1]) for x in self.held[:-1]])
        folded = _tables()[0][np.concatenate([x[1] for x in self.held])]
        h = np.concatenate([_seeds(x[0])[x[4]] for x in self.held])
        at = np.concatenate([x[2] + a for x, a in zip(self.held, starts)])
        least = np.repeat(starts, [len(x[2]) for x in self.held])
        weight = np.concatenate([x[3] for x in self.held])
        self.held, self.n = [], 0
        for k in range(ORDER + 1):
            if k:
                keep = at - k + 1 >= least
                h, at, least, weight = h[keep], at[keep], least[keep], weight[keep]
                h = (h ^ (folded[at - k + 1] + np.uint64(1))) * np.uint64(_FACTOR)
                h ^= h >> np.uint64(32)
            slots = (h >> self.shift).view(np.int64)
            i = self.slot[slots]
            known = self.hashes[i] == h
            other = np.flatnonzero(self.shared[slots] & ~known)
            if len(other):
                i[other] = np.minimum(np.searchsorted(self.hashes, h[other]), len(self.hashes) - 1)
                known[other] = self.hashes[i[other]] == h[other]
            h, at, least, weight, i = h[known], at[known], least[known], weight[known], i[known]
            self.counts += np.bincount(i, weight, len(self.counts)).astype(np.int64)


class BackwardModel:
    """Counts of [ends, goes on] by context."""

    def __init__(self):
        self.counts: dict[str, list[float]] = {}

    def add(self, text: str) -> None:
        """Counts the end of a text (unless a remark says that it was cut) and all places where it goes on."""
        s, marked = final(text)
        if not s:
            return
        if not marked:
            self._add(s, 0)
        for k in range(1, len(s)):
            self._add(s[:k].rstrip() or s[:1], 1)

    def _add(self, s: str, what: int) -> None:
        for c in contexts(s):
            self.counts.setdefault(c, [0.0, 0.0])[what] += 1.0

    def log_odds(self, s: str) -> float:
        """Of ending against going on after ``s``: the mean of what the whole context and what is open alone say."""
        p, opened = 0.02, None
        for c in contexts(s):
            got = self.counts.get(c)
            if got is None:
                if not c.endswith("|"):
                    break
                continue
            p = (got[0] + WEIGHT * p) / (got[0] + got[1] + WEIGHT)
            opened = p if opened is None else opened
        return (_logit(p) + _logit(0.02 if opened is None else opened)) / 2


def _logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else (30.0 if p else -30.0)


SCORES = "record_kind string, record_id long, ai string, lang string, log_odds double, marked boolean, open boolean, natural boolean"


def _score_batches(models: dict[str, dict[str, list[float]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for kind, counts in models.items():
            held[kind] = BackwardModel()
            held[kind].counts = counts
        cols = ["record_kind", "record_id", "ai", "lang", "log_odds", "marked", "open", "natural"]
        for pdf in batches:
            rows = []
            for kind, rid, ai, text in zip(pdf["record_kind"], pdf["record_id"], pdf["ai"], pdf["body"]):
                s, marked = final(text)
                if s or marked:
                    st = state(s) if s else "F"
                    rows.append((kind, rid, ai, language(s), (held[kind].log_odds(s) if s else -30.0) - REMARK * marked, marked, st in OPEN, not marked and bool(s) and natural(s, st)))
            yield pd.DataFrame(rows, columns=cols).astype({"record_id": "int64", "log_odds": "float64", "marked": "bool", "open": "bool", "natural": "bool"})

    return run


def _end_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, str], float] = {}

    def rows() -> pd.DataFrame:
        out = [(k, c, np.uint64(context_hash(k, c)).astype(np.int64), e) for (k, c), e in held.items()]
        held.clear()
        return pd.DataFrame(out, columns=["record_kind", "context", "hash", "ends"]).astype({"hash": "int64", "ends": "float64"})

    for pdf in batches:
        for kind, text in zip(pdf["record_kind"], pdf["body"]):
            s, marked = final(text)
            for c in contexts(s) if s else ():
                held[kind, c] = held.get((kind, c), 0.0) + (not marked)
        if len(held) > HELD_CONTEXTS:
            yield rows()
    yield rows()


def _place_batches(hashes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(hashes)
        for pdf in batches:
            for kind, text in zip(pdf["record_kind"], pdf["body"]):
                places.add(kind, text)
        places.flush()
        some = np.flatnonzero(places.counts)
        yield pd.DataFrame({"hash": places.hashes[some].view(np.int64), "goes": places.counts[some].astype("float64")})

    return run


def fit(texts: DataFrame) -> dict[str, dict[str, list[float]]]:
    """The counts of each column's model in the contexts in which texts end, over all its texts and all their places."""
    spark = texts.sparkSession
    texts = texts.select("record_kind", "body")
    ends = texts.mapInPandas(_end_batches, "record_kind string, context string, hash long, ends double")
    ends = Stage(spark, "ends").put(ends.groupBy("record_kind", "context", "hash").agg(F.sum("ends").alias("ends")))
    hashes = ends.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
    if not len(hashes):
        return {}
    goes = texts.mapInPandas(_place_batches(hashes), "hash long, goes double").groupBy("hash").agg(F.sum("goes").alias("goes"))
    counts = ends.join(goes, "hash", "left").na.fill(0.0, ["goes"]).where("ends + goes > 0")
    size = texts.groupBy("record_kind").agg(F.greatest(F.lit(LEAST_SUPPORT), F.count(F.lit(1)) * SUPPORT).alias("least"))
    kept = counts.join(F.broadcast(size), "record_kind").where((F.col("ends") + F.col("goes") / 20 >= F.col("least")) | (F.length("context") < 6))  # a row a column
    models: dict[str, dict[str, list[float]]] = {}
    for kind, context, e, g in kept.select("record_kind", "context", "ends", "goes").collect():
        models.setdefault(kind, {})[context] = [e, g]
    return models


def valley(bins: list[tuple[float, int]], low: float = LOWEST, high: float = HIGHEST) -> float:
    """The threshold between the two heaps of a histogram: the middle of the emptiest stretch within bounds."""
    if not bins:
        return (low + high) / 2
    grid = np.arange(low, high + 1e-9, 0.25)
    x = np.array([b for b, _ in bins])
    n = np.array([c for _, c in bins], dtype=float)
    near = np.array([(n * np.exp(-0.5 * ((x - g) / 0.25) ** 2)).sum() for g in grid])
    return float(grid[np.flatnonzero(near <= near.min() + 1e-9)].mean())


def scored(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``SCORES`` and threshold, is_cut of ``texts`` (record_kind, record_id, ai, body)."""
    texts = texts.where("record_id is not null").where(F.col("body").rlike(r"\S"))
    models = fit(texts)
    st = Stage(spark, "truncation")
    scores = st.put(texts.mapInPandas(_score_batches(models), SCORES))
    b = F.round(F.greatest(F.least("log_odds", F.lit(12.0)), F.lit(-12.0)) * 4) / 4
    bins: dict[tuple, list] = {}
    for kind, lang, x, n in scores.groupBy("record_kind", "lang", b.alias("b")).count().collect():  # at most 97 bins a language and column
        bins.setdefault((kind, lang), []).append((x, n))
    limits = spark.createDataFrame([(k, g, valley(v)) for (k, g), v in bins.items()] or [("", "", 0.0)], "record_kind string, lang string, threshold double")
    out = scores.join(F.broadcast(limits), ["record_kind", "lang"])
    # what the model suspects, near the threshold too, an exact check may refute
    return out.withColumn("is_cut", (F.col("log_odds") < F.col("threshold") + NEAR) & ~F.col("natural"))


def translated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "headers", "header_id", "ai", "raw_translated_code")
    m = load(spark, sf_dir, "methods", "method_id", "ai", "raw_translated_code")
    return h.select(F.lit("headers").alias("record_kind"), F.col("header_id").alias("record_id"), "ai", F.col("raw_translated_code").alias("body")).union(
        m.select(F.lit("methods").alias("record_kind"), F.col("method_id").alias("record_id"), "ai", F.col("raw_translated_code").alias("body"))
    )


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, translated_texts(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_scores(spark, sf_dir).where("is_cut").select("record_kind", "record_id").distinct()


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts for each model and table."""
    s = p6_scores(spark, sf_dir)
    cut = F.sum(F.col("is_cut").cast("long"))
    return s.groupBy("ai", "record_kind").agg(F.count(F.lit(1)).alias("n_texts"), cut.alias("n_cut"), F.round(cut / F.count(F.lit(1)), 6).alias("cut_share"))
