"""Semi-structured log lines into fields by a fixed-depth template tree.

1. Variables of every line are masked: digits one by one, quoted values, paths, names in mixed case. What is left is
   the line's shape; shapes are counted over all lines.
2. A shape is routed by its number of tokens and its leading tokens to a leaf of the tree. Shapes of a leaf merge
   where they differ in variable places only: a place of plain words is variable if the words met there are many
   (their effective number, the inverse of the sum of squared shares, passes ``VARIABLE``). Neither order nor
   partitioning of the lines matters, and no leaf is gathered: all of it are grouped counts.
3. For each template the places of time, level, component and message are determined once (``find_layout``).
4. Every line is parsed by the places of its template. A line whose template has no level and no time starts no entry
   and belongs to the entry before it.

Level words, signs, digits and leading tokens are never merged, so the lines of a template agree in all that tells
where fields stand; what a template adds is whether a word stands for a component or begins the message.

Null and empty texts give no entries; lines before the first entry of a text belong to none; a text
without any entry gives none. Times without zone are UTC, without year they take that of recorded_at
(none where that is null). Rows with equal ids are parsed each for itself. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Stage, load, small

# Words and signs for levels.
LEVEL_WORDS = {
    "fatal": "fatal critical crit emerg emergency alert panic ftl f fatale kritisch critique crítico critico fatal: критическая критично 致命 致命的 严重 重大",
    "error": "error err severe errors e fehler erreur erro ошибка 错误 錯誤 エラー 誤り",
    "warn": "warn warning wrn w warnung avertissement attention advertencia aviso предупреждение внимание 警告",
    "info": "info information notice inf i informational hinweis información informação información informacion информация сведения 信息 情報 通知",
    "debug": "debug fine finer finest dbg trace d verbose depuración dépannage отладка 调试 デバッグ",
    "note": "note notes anmerkung remarque nota примечание 注 附注 注記 注意",
}
LEVEL = {w: k for k, ws in LEVEL_WORDS.items() for w in ws.split()}
# Month names of the notations met in logs.
MONTHS = {
    m: i % 12 + 1
    for i, m in enumerate(
        "jan feb mar apr may jun jul aug sep oct nov dec "
        "ene fév mär avr mai juin juil ago set okt nov dez".split()
    )
} | {"mrz": 3, "abr": 4, "fev": 2, "out": 10, "août": 8, "déc": 12, "dic": 12}

#: How many words may stand in a place, by their effective number, before it counts as variable.
VARIABLE = 12.0
#: Leading tokens that route a line, separators counted.
LEAD = 5

ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
ZONE = r"(?P<zone>Z|UTC|GMT|[+-]\d{2}:?\d{2})?"
ISO = r"(?P<Y>\d{4})[-/.](?P<M>\d{1,2})[-/.](?P<D>\d{1,2})[T ]+(?P<h>\d{1,2}):(?P<m>\d{2}):(?P<s>\d{2})(?:[.,]\d+)?\s?" + ZONE
TIME_FORMS = [
    re.compile(ISO),
    re.compile(r"(?P<Y>\d{4})年(?P<M>\d{1,2})月(?P<D>\d{1,2})日\s*(?P<h>\d{1,2})[:时時](?P<m>\d{2})[:分](?P<s>\d{2})秒?\s?" + ZONE),
    re.compile(r"(?P<D>\d{1,2})[/ .-](?P<mon>[^\W\d_]{3,5})\.?[/ .-](?P<Y>\d{4})[: T](?P<h>\d{2}):(?P<m>\d{2}):(?P<s>\d{2})(?:[.,]\d+)?\s?" + ZONE),
    re.compile(r"(?P<D>\d{1,2})\.(?P<M>\d{1,2})\.(?P<Y>\d{4})[ ,T]+(?P<h>\d{1,2}):(?P<m>\d{2}):(?P<s>\d{2})(?:[.,]\d+)?\s?" + ZONE),
    re.compile(r"(?P<mon>[A-Z][a-zé]{2,4})\.?\s+(?P<D>\d{1,2})\s+(?:(?P<Y>\d{4})\s+)?(?P<h>\d{2}):(?P<m>\d{2}):(?P<s>\d{2})(?:[.,]\d+)?\s?" + ZONE),
]
_GLOG_TIME = re.compile(r"(?P<M>\d{2})(?P<D>\d{2}) (?P<h>\d{2}):(?P<m>\d{2}):(?P<s>\d{2})")
GLOG = re.compile(r"([A-Z])(\d{4} \d{2}:\d{2}:\d{2})(?:\.\d+)?\s+\d+\s+([\w.+-]+):\d+\]\s?")
_SOURCE_END = re.compile(r"\.(?:cc|cpp|go|h|py)$")
# Letters for levels.
GLOG_LEVEL = {"I": "info", "W": "warn", "E": "error", "F": "fatal", "D": "debug", "V": "debug", "C": "fatal", "N": "info"}
EPOCH = re.compile(r"[\[(]?(?P<e>\d{9,10}(?:\.\d+)?|\d{13}|\d{16}|\d{19})[\])]?(?=[\s,:|]|$)")
DIAGNOSTIC = re.compile(r"(?P<comp>(?:[A-Za-z]:)?[^\s:|\"'()][^:|\"']*?(?::\d+){1,2}|[\w./+-]+):\s+(?P<lv>fatal error|error|warning|note|remark|Fehler|erreur|Warnung|avertissement|[^\W\d_]+(?: [^\W\d_]+)?)\s*[:：]\s?", re.I)
LOGFMT = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:\\.|[^"\\])*"|\S*)')
JSON_KEY = re.compile(r'"((?:\\.|[^"\\])*)"\s*:\s*("(?:\\.|[^"\\])*"|-?\d+(?:\.\d+)?|true|false|null)')
BRACKET_LEVEL = re.compile(r"\s*[\[<(【「]\s*([^\W\d_]{1,16})\s*[\]>)】」]\s*:?\s*")
PLAIN_LEVEL = re.compile(r"\s*[-|]?\s*([^\W\d_]{1,16})(?=[\s:：|,\]]|$)[:：]?\s*")
THREADED = re.compile(r"\[[^\]]*\]\s+([\w.$/-]+)\s+-\s+")
COMPONENT = re.compile(r"\s*(?:\[([\w .:#/-]+)\]\s*|\(([\w.:#/-]+)\)\s*|([\w.$/#-]+)(?:\[\d+\])?\s*(?:[:：]|\s-\s)\s*|([\w.$/#-]+)(?:\[\d+\])?(?=\s)\s*)")
WORD_BEFORE_LEVEL = re.compile(r"\s*(\[[^\]]*\]|\([^)]*\)|[^\s:：]+)\s*[:：]?\s*-?\s*")
COLON_LEVEL = re.compile(r"([^\W\d_]{3,12})\s*[:：]\s+")
CAPITAL_LEVEL = re.compile(r"([A-Z]{4,8})\s+(?=[\[(\w])")
COMPONENT_AHEAD = re.compile(r"[\[(]?[\w.$-]+[\])]?\s*[:-]\s")
EXCERPT = re.compile(r"\d+\s*\|")
# Keys of structured entries.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t", "datetime", "date", "asctime")
LEVEL_KEYS = ("level", "lvl", "severity", "levelname", "loglevel", "log.level", "sev")
COMP_KEYS = ("logger", "component", "module", "name", "source", "caller", "service", "comp", "program", "app")
MSG_KEYS = ("msg", "message", "text", "event")
#: Starts of lines that continue an entry: include traces, stack traces, quotations.
CONTINUED = ("In file included", "from ", "Caused by", "Traceback", "...", ">", "at ", "File ", "|", "^", "~")

#: Tokens of lines and shapes: quoted values, words, white space, signs.
_DOUBLE, _SINGLE, _NAME = r'"(?:\\.|[^"\\])*"', r"'[^']*'", r"[\w.$/+@-]+"
TOKEN = re.compile(rf"{_DOUBLE}|{_SINGLE}|{_NAME}|\s+|[^\w\s]")
_PLAIN = re.compile(r"[^\W\d_]+")


# ------------------------------------------------------------------ masking, in the engine
#: Characters that are taken off at both ends of a line.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\ufeff"


def _where(line: Column, sign: str, changed: Column) -> Column:
    """``changed`` only where the sign occurs: a search for a sign costs less than one for a pattern."""
    return F.when(F.contains(line, F.lit(sign)), changed).otherwise(line)


def clean(line: Column) -> Column:
    """The line without colours, byte order marks and outer white space."""
    return F.btrim(_where(line, "\x1b", F.regexp_replace(line, ANSI, "")), F.lit(_BLANKS))


def mask(line: Column) -> Column:
    """The shape of a clean line. Masks stay within tokens, so a shape has as many tokens as its lines."""
    levels = "|".join(sorted({w for w in LEVEL if w.isascii() and w.isalpha() and len(w) > 1}))
    # one pass over all quotes, as tokens are found; the second takes the mark behind a key off again
    quotes = F.regexp_replace(F.regexp_replace(line, rf"({_DOUBLE}(?=\s*:))|{_DOUBLE}|{_SINGLE}", '$1"Q"'), r'""Q"(?=\s*:)', '"')
    s = F.when(F.contains(line, F.lit('"')) | F.contains(line, F.lit("'")), quotes).otherwise(line)
    s = _where(s, "/", F.regexp_replace(s, r"(?<![\w.$/+@-])[\w.+@-]*/[\w./+@-]+(?![\w$])", "P"))
    # names in mixed case, but for level words however they are written
    named = F.regexp_replace(s, rf"(?<![A-Za-z0-9_$])(?=[A-Za-z0-9_$]*?[a-z][A-Z])(?!(?i:{levels})(?![A-Za-z0-9_$]))[A-Za-z0-9_$]++", "W")
    s = F.when(s.rlike("[a-z][A-Z]"), named).otherwise(s)
    return F.translate(s, "123456789", "000000000")


# ------------------------------------------------------------------ times and levels
def _text_time(g: dict, year: int | None) -> str | None:
    """A time's groups as UTC text, fractions cut off."""
    try:
        y = int(g["Y"]) if g.get("Y") else year
        if y is None:
            return None
        month = MONTHS.get(g["mon"].lower().rstrip("."), MONTHS.get(g["mon"].lower()[:3])) if g.get("mon") else int(g["M"])
        t = datetime(y, month, int(g["D"]), int(g["h"]), int(g["m"]), int(g["s"]))
        z = g.get("zone")
        if z and z[0] in "+-":
            off = timedelta(hours=int(z[1:3]), minutes=int(z[-2:]))
            t -= off if z[0] == "+" else -off
        return t.isoformat(" ") if t.year > 999 else None
    except (ValueError, TypeError, OverflowError):
        return None


def _epoch(text: str) -> str | None:
    try:
        whole = text.partition(".")[0]
        secs = int(whole[:-9] if len(whole) == 19 else whole[:-6] if len(whole) == 16 else whole[:-3] if len(whole) == 13 else whole)
        return datetime.fromtimestamp(secs, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    except (ValueError, OverflowError, OSError):
        return None


def to_time(text: str, form: str, year: int | None) -> str | None:
    """The UTC time that a field's text gives."""
    if form == "glog":
        m = _GLOG_TIME.match(text)
        return _text_time(m.groupdict(), year) if m else None
    text = text.strip()
    if m := EPOCH.fullmatch(text):
        return _epoch(m["e"])
    for pattern in TIME_FORMS:
        if m := pattern.match(text):
            return _text_time(m.groupdict(), year)
    return None


def to_level(word: str | None) -> str | None:
    if not word:
        return None
    w = word.strip().strip('"').lower()
    return "fatal" if w.startswith("fatal") else LEVEL.get(w)


# ------------------------------------------------------------------ where the fields of a template stand
class Places:
    """Spans of the fields in an example: time, level, comp, msg as (start, end); ``form`` says how values are read."""

    def __init__(self, form: str, level=None, time=None, comp=None, msg=None):
        self.form, self.level, self.time, self.comp, self.msg = form, level, time, comp, msg


def _value(m: re.Match, group: int) -> tuple[int, int]:
    a, b = m.span(group)
    return (a + 1, b - 1) if b - a > 1 and m[group][0] == '"' else (a, b)


def _keyed(found: list[re.Match], form: str) -> Places | None:
    at = {m[1].lower(): _value(m, 2) for m in found}
    pick = lambda keys: next((at[k] for k in keys if k in at), None)
    level = pick(LEVEL_KEYS)
    return level and Places(form, level, pick(TIME_KEYS), pick(COMP_KEYS), pick(MSG_KEYS) or (0, 0))


def _component(t: str, pos: int, variable) -> tuple[tuple[int, int] | None, int]:
    """(span of the component at ``pos``, where the message begins)."""
    if m := THREADED.match(t, pos):  # [thread] logger - message
        return m.span(1), m.end()
    m = COMPONENT.match(t, pos)
    if m and not (m[4] and variable(m.start(4))):  # a word among many others begins the message
        return next(m.span(k) for k in (1, 2, 3, 4) if m[k]), _skip(t, m.end(), "-:： ")
    return None, pos


def _skip(t: str, pos: int, signs: str) -> int:
    while pos < len(t) and t[pos] in signs:
        pos += 1
    return pos


def _after_time(t: str, time: tuple[int, int], pos: int, variable) -> Places | None:
    """Level and component after a time: in either order, or host program[pid]: level: message."""
    pos = _skip(t, pos, "])> |-,:\t")
    m = BRACKET_LEVEL.match(t, pos)
    if not (m and to_level(m[1])):
        m = PLAIN_LEVEL.match(t, pos)
        m = m if m and to_level(m[1]) and len(m[1]) > 1 else None
    if m:
        comp, msg = _component(t, _skip(t, m.end(), ":： "), variable)
        return Places("time", m.span(1), time, comp, (msg, len(t)))
    words: list[tuple[int, int]] = []
    for _ in range(4):  # up to three words (host, program, thread) before the level
        w = WORD_BEFORE_LEVEL.match(t, pos)
        if not w:
            break
        a, b = w.span(1)
        if t[a] in "[(<【":
            a, b = a + 1, b - 1 if t[b - 1] in "])>】" else b
        if words and b - a > 1 and to_level(t[a:b]):
            ca, cb = words[-1]
            if tail := re.search(r"\[\d+\]$", t[ca:cb]):
                cb = ca + tail.start()
            return Places("time", (a, b), time, (ca, cb), (_skip(t, w.end(), ":： "), len(t)))
        words.append((a, b))
        pos = w.end()
    return None if words else Places("time only", None, time, None, (pos, len(t)))


def _timed(t: str, variable) -> Places | None:
    off = 1 if t[0] in "[(<" else 0
    if not (t[off : off + 1].isdigit() or t[off : off + 1].isupper()):
        return None
    for pattern in TIME_FORMS:
        if m := pattern.match(t, off):
            return _after_time(t, m.span(), m.end(), variable)
    if m := EPOCH.match(t):
        return _after_time(t, m.span("e"), m.end(), variable)
    return None


def _level_first(t: str, variable) -> Places | None:
    """[LEVEL] message, LEVEL: message, LEVEL component: message; without time."""
    if t[0] in "[【<" and (m := BRACKET_LEVEL.match(t)) and to_level(m[1]) and len(m[1]) > 1:
        comp, msg = _component(t, m.end(), variable)
        return Places("level", m.span(1), None, comp, (msg, len(t)))
    if (m := COLON_LEVEL.match(t)) and to_level(m[1]):
        return Places("level", m.span(1), None, None, (m.end(), len(t)))
    if (m := CAPITAL_LEVEL.match(t)) and to_level(m[1]) and COMPONENT_AHEAD.match(t, m.end()):
        comp, msg = _component(t, m.end(), variable)
        return Places("level", m.span(1), None, comp, (msg, len(t)))
    return None


def find_places(t: str, variable=lambda pos: False) -> Places | None:
    """The fields' places in a clean line, None if it starts no entry. ``variable`` tells of a place whether many words stand there."""
    if not t or t.startswith(CONTINUED):
        return None
    if t[0] == "{" and (p := _keyed(list(JSON_KEY.finditer(t)), "json")):
        return p
    if t[0].isalpha() and LOGFMT.match(t):
        found = list(LOGFMT.finditer(t))
        if len(found) > 1 and (p := _keyed(found, "logfmt")) and to_level(t[slice(*p.level)]):
            return p
    if (m := GLOG.match(t)) and m[1] in GLOG_LEVEL:
        return Places("glog", m.span(1), m.span(2), m.span(3), (m.end(), len(t)))
    if p := _timed(t, variable):
        return p
    if (m := DIAGNOSTIC.match(t)) and to_level(m["lv"]) and not EXCERPT.match(t):
        return Places("diagnostic", m.span("lv"), None, m.span("comp"), (m.end(), len(t)))
    return _level_first(t, variable)


def layout(example: str, variable: frozenset = frozenset()) -> str | None:
    """The places of an example's fields by token, as text: form, a pattern of the tokens up to the last field, and the fields' ends."""
    found = list(TOKEN.finditer(example))
    starts = {m.start(): i for i, m in enumerate(found)}
    p = find_places(example, lambda pos: starts.get(pos) in variable)
    if p is None:
        return None
    fields, last = {}, 0
    for name in ("time", "level", "comp", "msg"):
        span = getattr(p, name)
        if span is None or (name == "msg" and span == (0, 0)):
            continue
        a, b = span
        i = next((k for k, m in enumerate(found) if m.start() <= a < m.end()), len(found))
        if name == "msg" and b == len(example):
            fields[name] = [i, a - found[i].start() if i < len(found) else 0, -1, 0]
            last = max(last, i)
            continue
        j = next((k for k, m in enumerate(found) if m.start() < b <= m.end()), i) if b > a else i
        fields[name] = [i, a - found[i].start(), j, found[j].end() - b]
        last = max(last, j)
    parts = []
    for m in found[: last + 1]:
        t = m[0]
        kind = _DOUBLE if t[0] == '"' and len(t) > 1 else _SINGLE if t[0] == "'" and len(t) > 1 else r"\s+" if t.isspace() else _NAME if re.fullmatch(_NAME, t) else re.escape(t)
        parts.append(f"({kind})")
    return json.dumps([p.form, "".join(parts), fields], ensure_ascii=False)


class Reader:
    """Reads lines by their templates' layouts."""

    def __init__(self):
        self.layouts: dict[str, tuple] = {}
        self.times: dict[tuple, str | None] = {}

    def __call__(self, t: str, how: str, year: int | None) -> tuple | None:
        """(time or None, level, component, message); None if the values make no entry."""
        got = self.layouts.get(how)
        if got is None:
            form, pattern, fields = json.loads(how)
            got = self.layouts[how] = (form, re.compile(pattern), [fields.get(k) for k in ("time", "level", "comp", "msg")])
        form, pattern, fields = got
        m = pattern.match(t)
        if not m:
            return None
        time, word, comp, msg = [f and (t[(m.start(f[0] + 1) if f[0] < len(m.groups()) else len(t)) + f[1] : m.end(f[2] + 1) - f[3] if f[2] >= 0 else len(t)]) for f in fields]
        level = GLOG_LEVEL.get(word) if form == "glog" else to_level(word)
        if time is not None:
            key = (time, form == "glog", year)
            if key not in self.times:
                if len(self.times) > 200_000:  # bounds memory only
                    self.times.clear()
                self.times[key] = to_time(time, form, year)
            time = self.times[key]
        if form == "time only":
            level = "info" if time else None
        if level is None:
            return None
        if form == "glog":
            comp = _SOURCE_END.sub("", comp)
        if form in ("json", "logfmt"):
            msg = re.sub(r'\\(["\\/])', r"\1", msg) if msg else ""
        return time, level, comp, msg


def head(line: str, year: int | None) -> tuple | None:
    """A single line's fields, by a template of its own: (time or None, level, component, message)."""
    t = re.sub(ANSI, "", line).strip(_BLANKS)
    how = layout(t)
    return Reader()(t, how, year) if how else None


# ------------------------------------------------------------------ the tree
def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tokens = [TOKEN.findall(s) for s in pdf["shape"]]
        leaf = [f"{len(t)} " + "".join(t[:LEAD]) for t in tokens]
        # plain words between blanks, not leading ones and no levels, may be variable
        places = [[k for k in range(LEAD, len(t)) if _PLAIN.fullmatch(t[k]) and t[k - 1].isspace() and (k + 1 == len(t) or t[k + 1].isspace()) and to_level(t[k]) is None] for t in tokens]
        yield pd.DataFrame({"shape": pdf["shape"], "n": pdf["n"], "example": pdf["example"], "leaf": leaf, "tokens": tokens, "places": places})


def _templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for tokens, places, variable in zip(pdf["tokens"], pdf["places"], pdf["variable"]):
            v = set() if variable is None else set(variable)
            own = set(places) & v
            out.append("".join("<*>" if k in own else t for k, t in enumerate(tokens)))
        yield pd.DataFrame({"shape": pdf["shape"], "n": pdf["n"], "example": pdf["example"], "template": out, "variable": pdf["variable"]})


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        how = [layout(e, frozenset() if v is None else frozenset(v)) for e, v in zip(pdf["example"], pdf["variable"])]
        yield pd.DataFrame({"template": pdf["template"], "n": pdf["n"], "layout": how})


def template_tree(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape, template) and (template, n, layout) of ``lines`` (t, shape); layout is null where a template starts no entry."""
    st = Stage(spark, "templates")
    shapes = lines.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("example"))
    shapes = st.put(shapes.mapInPandas(_tokens, "shape string, n long, example string, leaf string, tokens array<string>, places array<int>"))
    words = shapes.select("leaf", "n", F.explode(F.transform("places", lambda k: F.struct(k.alias("place"), F.get("tokens", k).alias("word")))).alias("w"))
    words = words.groupBy("leaf", F.col("w.place").alias("place"), F.col("w.word").alias("word")).agg(F.sum("n").cast("double").alias("n"))
    many = words.groupBy("leaf", "place").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("kinds")).where(F.col("kinds") > VARIABLE)
    variable = many.groupBy("leaf").agg(F.collect_list("place").alias("variable"))  # at most as many places as a line has tokens
    merged = shapes.join(variable, "leaf", "left").select("shape", "n", "example", "tokens", "places", "variable")
    merged = st.put(merged.mapInPandas(_templates, "shape string, n long, example string, template string, variable array<int>"))
    one = merged.groupBy("template").agg(F.sum("n").alias("n"), F.min(F.struct("example", "variable")).alias("e"))
    layouts = one.select("template", "n", "e.example", "e.variable").mapInPandas(_layouts, "template string, n long, layout string")
    return merged.select("shape", "template"), layouts


# ------------------------------------------------------------------ parsing
def _read_batches(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for pdf in batches:
            got = [reader(t, how, None if pd.isna(y) else int(y)) if how is not None else None for t, how, y in zip(pdf["t"], pdf["layout"], pdf["yr"])]
            out = pdf[keys].copy()
            for k, name in enumerate(("entry_time", "log_level", "component", "message")):
                out[name] = [None if g is None else g[k] for g in got]
            yield out

    return run


_IDS = "record_kind string, record_id long, block_no int, line_no int"


def log_lines(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """The lines of ``blocks`` (record_kind, record_id, block_no, body, yr, and uid where texts are numbered already) with their shapes, written once."""
    texts = blocks.where("body is not null and body <> ''")
    texts = texts if "uid" in blocks.columns else texts.withColumn("uid", F.monotonically_increasing_id())
    lines = texts.select("uid", "record_kind", "record_id", "block_no", "yr", F.posexplode(F.split("body", "\n")).alias("k", "line"))
    lines = lines.select("uid", "record_kind", "record_id", "block_no", "yr", (F.col("k") + 1).alias("line_no"), clean(F.col("line")).alias("t"))
    return Stage(spark, "lines").put(lines.withColumn("shape", mask(F.col("t"))))


def parse_heads(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines that start entries, with their fields."""
    shapes, layouts = template_tree(spark, lines)
    known = Stage(spark, "layouts").put(shapes.join(layouts.where("layout is not null").select("template", "layout"), "template").select("shape", "layout"))
    held = lines.select("uid", *[c.split()[0] for c in _IDS.split(", ")], "yr", "t", "shape").join(small(known, 50_000), "shape")
    keys = ["uid", "record_kind", "record_id", "block_no", "line_no"]
    heads = held.select(*keys, "yr", "t", "layout").mapInPandas(_read_batches(keys), f"uid long, {_IDS}, entry_time string, log_level string, component string, message string")
    return heads.where("log_level is not null")


def parse_logs(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """Entries of ``blocks`` with their continuation lines, which are cut out of the texts by the places of the heads."""
    texts = Stage(spark, "texts").put(blocks.where("body is not null and body <> ''").withColumn("uid", F.monotonically_increasing_id()))
    heads = parse_heads(spark, log_lines(spark, texts)).select("uid", F.struct("line_no", "entry_time", "log_level", "component", "message").alias("h"))
    heads = heads.groupBy("uid").agg(F.sort_array(F.collect_list("h")).alias("hs"))  # one text a group
    rows = texts.select("uid", "record_kind", "record_id", "block_no", F.split("body", "\n").alias("ls")).join(heads, "uid")

    def entry(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get("hs", i + 1)["line_no"], F.size("ls") + 1)
        more = F.transform(F.slice("ls", h["line_no"] + 1, end - h["line_no"] - 1), lambda x: F.regexp_replace(x, r"\r+$", ""))
        body = F.array_join(F.concat(F.array(h["message"]), more), "\n")
        return F.struct(h["line_no"].alias("line_no"), F.coalesce(h["entry_time"], F.lit("none")).alias("entry_time"), h["log_level"].alias("log_level"), h["component"].alias("component"), body.alias("message"), (end - h["line_no"]).alias("n_lines"))

    return rows.select("record_kind", "record_id", "block_no", F.explode(F.transform("hs", entry)).alias("e")).select("record_kind", "record_id", "block_no", "e.*")


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "compile_result", "result_id", "log_output", "recorded_at")
    f = load(spark, sf_dir, "compile_feedback", "feedback_id", "diagnostic_blocks", "recorded_at")
    # the year in UTC, whatever the session's zone
    year = F.year(F.to_utc_timestamp("recorded_at", F.current_timezone())).alias("yr")
    a = r.select(F.lit("compile_result").alias("record_kind"), F.col("result_id").alias("record_id"), F.lit(0).alias("block_no"), F.col("log_output").alias("body"), year)
    b = f.select(F.lit("compile_feedback").alias("record_kind"), F.col("feedback_id").alias("record_id"), F.posexplode("diagnostic_blocks").alias("pos", "body"), year)
    return a.union(b.select("record_kind", "record_id", (F.col("pos") + 1).alias("block_no"), "body", "yr"))


def p7_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries with time, level, component and message."""
    return parse_logs(spark, log_blocks(spark, sf_dir))


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of all lines with how many lines they cover and whether they start entries."""
    _, layouts = template_tree(spark, log_lines(spark, log_blocks(spark, sf_dir)))
    return layouts.select("template", F.col("n").alias("n_lines"), F.col("layout").isNotNull().alias("starts_entry"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = parse_heads(spark, log_lines(spark, log_blocks(spark, sf_dir)))
    return heads.select("record_kind", "record_id", "block_no", "line_no", "log_level", F.coalesce("entry_time", F.lit("none")).alias("entry_time")).distinct()
