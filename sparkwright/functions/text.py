"""Text functions. Column expressions where SQL can say it; functions over batches where a parser is needed."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch(fn: Callable, returns: T.DataType = T.StringType()) -> Callable[..., Column]:
    """A column function from a Python function of strings; Arrow batches, each distinct value computed once. Null in, null out."""

    def run(c: pd.Series) -> pd.Series:
        return c.map({x: fn(x) for x in c.dropna().unique()}).astype(object).where(c.notna(), None)

    run.__annotations__ = {"c": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


# ---- names of files
# Names that some file systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]


def sanitize_filename(c: Column) -> Column:
    """Signs that file systems refuse are replaced, reserved names get a leading underscore, 200 characters kept."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[:<>]", "-"), r"\?", "+"), r'[\\/*"|]', "_")
    s = F.when(F.upper(s).isin(RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.substring(s, 1, 200)


def short_graph_filename(c: Column, suffix: str = ".json") -> Column:
    s = sanitize_filename(c)
    return F.concat(F.when(F.length(s) > 80, F.concat(F.substring(s, 1, 60), F.lit("_"), F.substring(F.sha1(c), 1, 12))).otherwise(s), F.lit(suffix))


def sha_slug(c: Column, n: int = 48) -> Column:
    slug = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.concat(F.substring(slug, 1, n), F.lit("_"), F.substring(F.sha2(c, 256), 1, 12))


# ---- signatures and type names
def standard_signature(c: Column) -> Column:
    """``pkg.Class:method(pkg.T a,..)`` -> ``Class:method(T,..)``; ``<init>`` becomes the class; null without a colon."""
    owner = F.element_at(F.split(F.split(c, ":")[0], r"\."), -1)
    rest = F.regexp_extract(c, r":(.*)$", 1)
    name = F.regexp_extract(rest, r"^([^(]*)", 1)
    args = F.regexp_extract(rest, r"\((.*)\)", 1)
    simple = F.transform(F.split(args, ","), lambda a: F.element_at(F.split(F.split(F.trim(a), " ")[0], r"\."), -1))
    name = F.when(name == "<init>", F.element_at(F.split(owner, r"\$"), -1)).otherwise(name)
    return F.when(c.contains(":"), F.concat(owner, F.lit(":"), name, F.lit("("), F.when(F.trim(args) == "", F.lit("")).otherwise(F.array_join(simple, ",")), F.lit(")")))


def erase_generics(c: Column, legacy: bool = False, depth: int = 6) -> Column:
    """Type arguments taken off; ``legacy`` keeps the residue that nested ones leave."""
    if legacy:
        return F.regexp_replace(c, r"<.*?>", "")
    for _ in range(depth):
        c = F.regexp_replace(c, r"<[^<>]*>", "")
    return c


def strip_packages(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(?:[a-z_][\w]*\.)+([A-Z]\w*)", "$1")


def split_top(s: str) -> list[str]:
    """Parts at commas outside all brackets."""
    parts, depth, cur = [], 0, ""
    for ch in s:
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and depth <= 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return parts + [cur.strip()] if cur.strip() or parts else []


_PARAM_NOISE = re.compile(r"@\w+(?:\([^)]*\))?\s*|\b(?:final|const|volatile)\b\s*")


def normalize_param(p: str) -> str:
    """A parameter's type: no annotations, modifiers, name or spaces."""
    p = _PARAM_NOISE.sub("", p.strip())
    m = re.match(r"(.+?[\s>\]&*.])\s*([A-Za-z_]\w*)\s*((?:\[\])*)$", p)
    if m and not re.match(r"(?:unsigned|signed|long|short)\s*$", m[1]):
        p = m[1] + m[3]
    return re.sub(r"\s+", "", p)


def normalize_signature(s: str) -> str:
    """name(types): no throws clause, modifiers, return type, type parameters or parameter names."""
    s = re.sub(r"\)\s*throws\b.*$", ")", s.strip())
    m = re.match(r"(.*?)\((.*)\)", s, re.S)
    if not m:
        return s
    name = re.split(r"[\s:.]+", re.sub(r"<[^<>]*>", "", m[1].strip()))[-1]
    types = []
    for p in split_top(m[2]):
        t = normalize_param(p)
        while (u := re.sub(r"<[^<>]*>", "", t)) != t:
            t = u
        types.append(re.split(r"\.(?!\.)", t)[-1] if not t.endswith("...") else re.split(r"\.(?!\.)", t[:-3])[-1] + "...")
    return f"{name}({','.join(types)})"


def method_name(c: Column) -> Column:
    """The bare name: after the owner, before the parameters."""
    return F.element_at(F.split(F.split(F.split(c, r"\(")[0], ":")[F.size(F.split(F.split(c, r"\(")[0], ":")) - 1], r"[.$]"), -1)


def name_candidates(c: Column) -> Column:
    """Spellings of a class name: as it is, its last part by each separator; in this order, once each."""
    bare = F.trim(erase_generics(c))
    return F.array_distinct(F.filter(F.array(bare, F.element_at(F.split(bare, r"\."), -1), F.element_at(F.split(bare, "::"), -1), F.element_at(F.split(bare, r"\$"), -1), F.regexp_replace(bare, r"\$", "::"), F.element_at(F.split(bare, r"[.$:]+"), -1)), lambda x: x != ""))


def signature_keys(c: Column) -> Column:
    """full, short owner, bare: the keys of a method, from the most to the least specific."""
    owner, rest = F.split(c, ":")[0], F.regexp_extract(c, r":(.*)$", 1)
    short = F.element_at(F.split(owner, r"[.$]"), -1)
    return F.array_distinct(F.array(c, F.concat(short, F.lit(":"), rest), rest))


# ---- code
_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)


def strip_comments(s: str) -> str:
    """Code without comments; literals stay as they are."""
    return _COMMENT.sub(lambda m: "" if m[0][0] == "/" else m[0], s)


def fenced_code(c: Column) -> Column:
    """The first fenced block's text, else the text itself trimmed."""
    inner = F.regexp_extract(c, r"(?s)```[A-Za-z+]*\s*\n(.*?)```", 1)
    return F.when(c.contains("```") & (inner != ""), F.trim(inner)).otherwise(F.trim(c))


def includes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r'#\s*include\s*[<"]([^>"]+)[>"]'), F.lit(1))


def forward_declarations(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?:class|struct)\s+(\w+)\s*;"), F.lit(1)))


def error_location(c: Column) -> Column:
    at = lambda k: F.regexp_extract(c, r"^\s*([^\s:][^:]*):(\d+):(\d+):\s*(?:fatal )?error:", k)
    return F.struct(at(1).alias("file_path"), F.coalesce(F.try_to_number(at(2), F.lit("999999999")).cast("int"), F.lit(0)).alias("line"), F.coalesce(F.try_to_number(at(3), F.lit("999999999")).cast("int"), F.lit(0)).alias("column"))


def missing_include(c: Column) -> Column:
    a = F.regexp_extract(c, r"fatal error: '([^']+)' file not found", 1)
    return F.when(a != "", a).otherwise(F.regexp_extract(c, r"([\w./+-]+): No such file or directory", 1))


def norm_path(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(?:\./)+", ""))


def balanced_block(t: str, i: int) -> str | None:
    """The bracketed block that begins at ``i``, strings respected."""
    close = {"{": "}", "[": "]"}[t[i]]
    depth, j, quoted = 0, i, False
    while j < len(t):
        ch = t[j]
        if quoted:
            if ch == "\\":
                j += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == t[i]:
            depth += 1
        elif ch == close:
            depth -= 1
            if not depth:
                return t[i : j + 1]
        j += 1
    return None


def json_part(t: str) -> str | None:
    """The first balanced object that parses, else the first balanced one."""
    first, i = None, t.find("{")
    while i >= 0:
        b = balanced_block(t, i)
        if b is not None:
            try:
                json.loads(b)
                return b
            except ValueError:
                first = first or b
        i = t.find("{", i + 1)
    return first


def canonical_json(v: str) -> str:
    """Sorted keys, no blanks, integral numbers without fraction, no minus zero; an error for NaN and infinities."""

    def norm(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a finite number")
            return int(x) if x == int(x) else x
        if isinstance(x, dict):
            return {k: norm(y) for k, y in x.items()}
        return [norm(y) for y in x] if isinstance(x, list) else x

    return json.dumps(norm(json.loads(v)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


# ---- types of the two languages in one notation
# Names of types by kind. Widths are kinds of their own.
JAVA_PRIMITIVES = ("boolean", "byte", "short", "int", "long", "float", "double", "char", "void")
CPP_PRIMITIVES = {
    "bool": "boolean", "int8_t": "byte", "int16_t": "short", "int": "int", "int32_t": "int", "size_t": "int", "int64_t": "long", "long": "long", "long long": "long",
    "float": "float", "double": "double", "char16_t": "char", "void": "void",
}
JAVA_COLLECTIONS = {
    "List": "sequence", "ArrayList": "sequence", "LinkedList": "sequence", "Collection": "sequence", "Iterable": "sequence", "Set": "set", "HashSet": "set",
    "Map": "map", "HashMap": "map", "LinkedHashMap": "map", "Optional": "optional", "CompletableFuture": "future", "Future": "future",
}
CPP_COLLECTIONS = {
    "vector": "sequence", "list": "sequence", "deque": "sequence", "set": "set", "unordered_set": "set", "map": "map", "unordered_map": "map",
    "optional": "optional", "future": "future", "shared_future": "future",
}
JAVA_STRINGS, CPP_STRINGS = ("String", "CharSequence"), ("string", "string_view")
JAVA_DATES, CPP_DATES = ("Date", "Instant", "LocalDate", "LocalDateTime"), ("time_point", "system_clock")
SMART_POINTERS = ("shared_ptr", "unique_ptr", "weak_ptr")
_JAVA_NOISE = re.compile(r"@\w+(?:\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|default|volatile|transient)\b")
_CPP_NOISE = re.compile(r"\b(?:const|volatile|static|inline|virtual|explicit|mutable|constexpr)\b|&")
_GENERIC = re.compile(r"([\w:.$]+)\s*<(.*)>$", re.S)


def _noted(kind: str, args: list[str]) -> str:
    return f"{kind}({','.join(args)})" if args else kind


def java_type_ir(t: str) -> str:
    """A Java type as kind or kind(args): primitives by width, string, date, array, collections, object; unknown for others."""
    t = " ".join(_JAVA_NOISE.sub("", t).replace("...", "[]").split())
    t = re.sub(r"^<[^>]+>\s*", "", t)
    if m := re.match(r"(.*?)\s*\[\s*\]$", t, re.S):
        return f"array({java_type_ir(m[1])})"
    m = _GENERIC.match(t)
    name, args = (m[1] if m else t).split(".")[-1], [java_type_ir(x) for x in split_top(m[2])] if m else []
    if name in JAVA_PRIMITIVES:
        return name
    if name in JAVA_STRINGS:
        return "string"
    if name in JAVA_DATES:
        return "date"
    if name in JAVA_COLLECTIONS:
        return _noted(JAVA_COLLECTIONS[name], args)
    return _noted("object", args) if re.fullmatch(r"[A-Z][A-Za-z0-9_$]*", name) or "$" in name else "unknown"


def cpp_type_ir(t: str) -> str:
    """A C++ type in the same notation, with a question mark if it may be null."""
    pointed = "*" in t
    t = " ".join(_CPP_NOISE.sub(" ", t).replace("*", " ").split())
    t = re.sub(r"\b(?:un)?signed char\b", "int8_t", t)
    m = _GENERIC.match(t)
    name, args = (m[1] if m else t).split("::")[-1], [cpp_type_ir(x) for x in split_top(m[2])] if m else []
    null = "?" if pointed or name in SMART_POINTERS or name == "optional" else ""
    if name == "char" and pointed:
        return "string?"
    if name in CPP_PRIMITIVES:
        return CPP_PRIMITIVES[name] + null
    if name in CPP_STRINGS:
        return "string" + null
    if name in CPP_DATES:
        return "date" + null
    if name in CPP_COLLECTIONS:
        return _noted(CPP_COLLECTIONS[name], args) + null
    return (_noted("object", args) if name else "unknown") + null


def _open(t: str) -> tuple[str, list[str]]:
    """(kind, arguments) of a noted type."""
    t = t.rstrip("?")
    kind, _, rest = t.partition("(")
    return kind, split_top(rest[:-1]) if rest else []


def same_type(java: str, cpp: str) -> bool:
    """Whether a noted C++ type may stand for a noted Java type; unknown ones may for any."""
    (k, xs), (l, ys) = _open(java), _open(cpp)
    if l == "optional" and ys and k != "optional":
        return same_type(java, ys[0])
    if "unknown" in (k, l):
        return True
    first = lambda: not xs or not ys or same_type(xs[0], ys[0])
    if k in ("string", "date"):
        return l in (k, "optional")
    if k == "array":
        return l == "string" and xs == ["char"] or l in ("sequence", "object") and first() or l == "array" and bool(xs and ys) and first()
    if k == "optional":
        return l == k and first()
    if k in ("sequence", "set", "map", "future"):
        return l == k and (not xs or not ys or len(xs) == len(ys) and all(map(same_type, xs, ys)))
    return k == l


def java_parameters(key: str) -> list[str]:
    m = re.search(r"\((.*)\)", key or "", re.S)
    return [normalize_param(p) for p in split_top(m[1])] if m else []
