"""Declarations of classes and functions in C++ and Java texts, read by matching brackets; for Arrow batches."""

from __future__ import annotations

import re

from .text import cpp_type_ir, java_parameters, java_type_ir, normalize_param, same_type, split_top, strip_comments

_KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "new", "throw", "else", "do", "sizeof", "delete"}
# C++ types of Java types, and of generic ones.
TYPES = {
    "boolean": "bool", "Boolean": "bool", "byte": "char", "Byte": "char", "short": "short", "Short": "short", "int": "int", "Integer": "int", "long": "long long", "Long": "long long",
    "float": "float", "Float": "float", "double": "double", "Double": "double", "char": "char", "Character": "char", "String": "std::string", "Object": "void*", "Class": "void*",
    "Duration": "std::chrono::duration<long long, std::nano>", "TimeUnit": "std::chrono::duration<long long, std::nano>",
    "Runnable": "std::function<void()>", "Callable": "std::function<void()>", "Function": "void*",
    "Throwable": "std::exception", "Exception": "std::exception", "RuntimeException": "std::runtime_error", "IllegalStateException": "std::runtime_error", "IllegalArgumentException": "std::invalid_argument",
    "NullPointerException": "std::runtime_error", "IOException": "std::runtime_error", "NoSuchElementException": "std::runtime_error", "UnsupportedOperationException": "std::runtime_error",
    "Future": "std::future<void>", "ScheduledFuture": "std::future<void>", "CompletableFuture": "std::future<void>", "Thread": "std::thread",
    "ExecutorService": "void*", "ScheduledExecutorService": "void*", "ScheduledThreadPoolExecutor": "void*", "ForkJoinPool": "void*", "Delayed": "void*",
}
GENERIC_TYPES = {
    "List": "std::vector", "ArrayList": "std::vector", "LinkedList": "std::list", "Collection": "std::vector", "Iterable": "std::vector", "Set": "std::set", "HashSet": "std::set", "TreeSet": "std::set",
    "Map": "std::map", "HashMap": "std::map", "TreeMap": "std::map", "Optional": "std::optional", "Queue": "std::deque", "Deque": "std::deque",
}
INCLUDES = {
    "std::string": "string", "std::vector": "vector", "std::list": "list", "std::set": "set", "std::map": "map", "std::optional": "optional", "std::deque": "deque", "std::chrono": "chrono", "std::function": "functional",
    "std::exception": "exception", "std::runtime_error": "stdexcept", "std::invalid_argument": "stdexcept", "std::future": "future", "std::thread": "thread",
}


def class_body(code: str, name: str) -> str | None:
    """The text between the braces of a class, or None."""
    m = re.search(rf"\b(?:class|struct|interface|enum(?:\s+class)?)\s+{re.escape(name)}\b[^;{{]*\{{", code)
    if not m:
        return None
    depth = 1
    for x in re.finditer(r"[{}]", code[m.end() :]):
        depth += 1 if x[0] == "{" else -1
        if not depth:
            return code[m.end() : m.end() + x.start()]
    return code[m.end() :]


def members(code: str) -> list[str]:
    """Declarations at the top level of a class body or file: up to their semicolon or body; bodies are left out."""
    out, depth, cur = [], 0, ""
    text = re.sub(r"(?m)^\s*#.*$", "", strip_comments(code))
    text = re.sub(r"\b(?:public|private|protected)\s*:", ";", text)
    for ch in text:
        if ch == "{":
            if depth == 0:
                out.append(cur.strip() + " {")
                cur = ""
            depth += 1
        elif ch == "}":
            depth = max(0, depth - 1)
        elif depth == 0:
            if ch == ";":
                out.append(cur.strip() + ";")
                cur = ""
            else:
                cur += ch
    return [d for d in (re.sub(r"\s+", " ", x) for x in out) if d not in (";", "{", " {")]


def parse_declaration(d: str) -> tuple[str, list[str]] | None:
    """(name, parameter types) of a function declaration; operators keep their sign; None for anything else, as for fields of a function type."""
    d = re.sub(r"^\s*template\s*<[^>]*>\s*", "", d)
    before = d.partition("(")[0]
    if "operator" not in before and before.count("<") > before.count(">"):
        return None
    m = re.search(r"(operator\s*[^\s\w(]+|operator\s*\(\)|~?[A-Za-z_]\w*)\s*\(", d)
    while m and m[1] in _KEYWORDS:
        m = re.compile(r"(~?[A-Za-z_]\w*)\s*\(").search(d, m.end())
    if not m:
        return None
    depth, i = 1, m.end()
    while i < len(d) and depth:
        depth += (d[i] == "(") - (d[i] == ")")
        i += 1
    if depth:
        return None
    return re.sub(r"\s+", "", m[1]), [normalize_param(re.sub(r"=.*$", "", p, flags=re.S)) for p in split_top(d[m.end() : i - 1])]


def cpp_method_names(code: str) -> list[str]:
    return list(dict.fromkeys(p[0] for d in members(code) if (p := parse_declaration(d))))


def find_declaration(code: str, owner: str, name: str, arity: int) -> str | None:
    """The declaration of a method in its class, by name and number of parameters; a class that is not there declares nothing, without one the whole text is searched."""
    for d in members((class_body(code, owner) or "") if owner else code):
        p = parse_declaration(d)
        if p and p[0] == name and len(p[1]) == arity:
            return d
    return None


def inheritance(source: str) -> tuple[str | None, str | None, list[str]]:
    """(name, extended type, implemented types) of the first type of a Java text."""
    m = re.search(r"\b(?:class|interface|enum)\s+([A-Za-z_]\w*)(?:<[^{]*?>)?\s*(?:extends\s+([^{]+?))?\s*(?:implements\s+([^{]+?))?\s*\{", strip_comments(source))
    if not m:
        return None, None, []
    ext = split_top(m[2]) if m[2] else []
    return m[1], ext[0] if ext else None, [*ext[1:], *(split_top(m[3]) if m[3] else [])]


def static_members(header: str) -> list[tuple[str, str]]:
    """(type, name) of static data members that need a definition elsewhere."""
    found = re.findall(r"(?m)^\s*static\s+(?!constexpr\b|inline\b)((?:const\s+)?[\w:<>, *&]+?)\s+([A-Za-z_]\w*)\s*;", strip_comments(header))
    return [(re.sub(r"\s+", " ", t.strip()), n) for t, n in found]


def static_definitions(header: str, owner: str, present: str) -> list[str]:
    """Definitions of static members that a text does not have yet."""
    return [f"{t} {owner}::{n};" for t, n in static_members(header) if not re.search(rf"\b{re.escape(owner)}::{re.escape(n)}\b", present or "")]


def parse_function(code: str, owner: str | None = None) -> dict:
    """Return type, owner and name of a function's text; constructors have no return type."""
    head = re.sub(r"\s+", " ", strip_comments(code).split("{")[0]).strip()
    m = re.match(r"(?:(.*?)\s)?(?:([\w:]+)::)?(~?[A-Za-z_]\w*|operator\S+)\s*\(", head)
    if not m:
        return {"name": None, "owner": owner, "return_type": None, "constructor": False}
    of = m[2] or owner
    ctor = bool(of) and m[3].lstrip("~") == of.split("::")[-1]
    ret = None if ctor else re.sub(r"\b(?:public|private|protected|static|final|virtual|inline|explicit|abstract|synchronized)\b\s*", "", m[1] or "").strip() or None
    return {"name": m[3], "owner": of, "return_type": ret, "constructor": ctor}


def map_type(t: str, params: tuple[str, ...] = ()) -> str:
    """A Java type in C++: generics, arrays, wildcards; type parameters stay, other classes keep their last name."""
    t = t.strip()
    if not t:
        return "void"
    if t.endswith(("[]", "...")):
        return f"std::vector<{map_type(t.rstrip('.') if t.endswith('...') else re.sub(r'(?:\[\]\s*)+$', '', t), params)}>"
    if t in params:
        return t
    if m := re.match(r"([A-Za-z_]\w*)<(.+)>$", t, re.S):
        if m[1] in TYPES:
            return TYPES[m[1]]
        args = ", ".join(map_type(a, params) for a in split_top(re.sub(r"\?\s*(?:extends|super)\s+", "", m[2])))
        return f"{GENERIC_TYPES.get(m[1], m[1])}<{args}>"
    name = t.split(".")[-1]
    return "void*" if not name or name.startswith("?") else TYPES.get(name, name)


def std_includes(cpp_type: str) -> list[str]:
    """Headers that a C++ type needs, sorted."""
    return sorted({h for c, h in INCLUDES.items() if c in cpp_type})


def signature_errors(java_key: str, cpp: str) -> list[str]:
    """What keeps a C++ declaration from standing for a Java method."""
    p = parse_declaration(cpp)
    if p is None:
        return ["no declaration"]
    want, errors = java_parameters(java_key), []
    name = re.split(r"[:.]", java_key.split("(")[0])[-1]
    if name not in ("<init>",) and p[0] != name:
        errors.append(f"name {p[0]}")
    if len(want) != len(p[1]):
        return [*errors, f"arity {len(p[1])} for {len(want)}"]
    return errors + [f"parameter {i}: {b} for {a}" for i, (a, b) in enumerate(zip(want, p[1]), 1) if not same_type(java_type_ir(a), cpp_type_ir(b))]


def header_errors(source: str, target: str) -> list[str]:
    """What a translated header lost of its source."""
    name, ext, impl = inheritance(source)
    if name is None:
        return []
    if class_body(target, name) is None:
        return [f"class {name} missing"]
    head = re.search(rf"\b(?:class|struct)\s+{re.escape(name)}\b([^{{;]*)\{{", target)
    bases = head[1] if head else ""
    short = lambda t: re.split(r"[.$]", re.sub(r"<.*", "", t))[-1].strip()
    return [f"base {short(b)} missing" for b in [ext, *impl] if b and not re.search(rf"\b{re.escape(short(b))}\b", bases)]


def skeleton(name: str, kind: str, bases: list[str], methods: list[tuple[str, str]]) -> str:
    """A header's outline: includes, bases and one declaration per (method key, source); the source gives the return type."""
    lines, need = [], set()
    for key, code in methods:
        method = re.split(r"[:.]", key.split("(")[0])[-1]
        types = [map_type(p) for p in java_parameters(key)]
        back = map_type(re.sub(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:<[^>]*>\s*)?", "", parse_function(code or "", name)["return_type"] or ""))
        for t in [*types, back]:
            need |= set(std_includes(t))
        args = ", ".join(f"{t} a{i}" for i, t in enumerate(types, 1))
        if method in (name, "<init>"):
            lines.append(f"    {name}({args});")
        else:
            lines.append(f"    virtual {back} {method}({args}){' = 0' if kind == 'interface' else ''};")
    inherit = " : " + ", ".join(f"public {b}" for b in bases) if bases else ""
    top = ["#pragma once", *(f"#include <{h}>" for h in sorted(need)), *(f'#include "{b}.h"' for b in bases), ""]
    return "\n".join([*top, f"class {name}{inherit} {{", "public:", f"    virtual ~{name}() = default;", *lines, "};", ""])


def assemble(includes: list[str], bodies: list[str]) -> str:
    """A file of distinct includes in order and its bodies."""
    return "\n".join([*dict.fromkeys(includes), "", *(b.strip() + "\n" for b in bodies if b and b.strip())])


_CODE_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|\w+|->|::|\S')
_HEADED = {"if", "for", "while", "synchronized", "catch", "switch"}


class _Statements:
    """Statements that stand directly in a block, at all depths, bodies of lambdas and of local classes' methods included."""

    def __init__(self, code: str):
        self.t, self.n = _CODE_TOKEN.findall(strip_comments(code)), 0

    def at(self, i: int) -> str:
        return self.t[i] if i < len(self.t) else ""

    def block(self, i: int, counted: bool = True) -> int:
        """From a block's opening brace to behind its closing one."""
        i += 1
        while i < len(self.t) and self.t[i] != "}":
            if not counted and self.t[i] in ("case", "default"):
                while i < len(self.t) and self.t[i] not in (":", "->", "}"):
                    i += 1
                i += self.at(i) in (":", "->")
                continue
            self.n += counted
            i = self.statement(i)
        return i + 1

    def parens(self, i: int) -> int:
        depth = 0
        while i < len(self.t):
            t = self.t[i]
            if t == "{":
                i = self.braces(i)
                continue
            depth += (t == "(") - (t == ")")
            i += 1
            if not depth:
                break
        return i

    def braces(self, i: int) -> int:
        """Braces inside an expression: the body of a lambda or method is a block, those of classes and arrays are not."""
        if self.at(i - 1) == "->" or self.at(i - 1) == ")" and not self.creates(i - 1):
            return self.block(i)
        i += 1
        while i < len(self.t) and self.t[i] != "}":
            i = self.braces(i) if self.t[i] == "{" else i + 1
        return i + 1

    def creates(self, i: int) -> bool:
        """Whether the parenthesis that closes at ``i`` belongs to ``new X(...)``."""
        depth = 0
        while i >= 0:
            depth += (self.t[i] == ")") - (self.t[i] == "(")
            if not depth:
                break
            i -= 1
        i -= 1
        while i > 0 and (self.t[i][0].isalnum() or self.t[i] in "._<>,?"):
            if self.t[i] == "new":
                return True
            i -= 1
        return i >= 0 and self.t[i] == "new"

    def statement(self, i: int) -> int:
        t = self.at(i)
        if t == "{":
            return self.block(i)
        if t in _HEADED and self.at(i + 1) == "(":
            i = self.parens(i + 1)
            if t == "switch":
                return self.block(i, False) if self.at(i) == "{" else i
            i = self.statement(i)
            return self.statement(i + 1) if t == "if" and self.at(i) == "else" else i
        if t == "do":
            i = self.statement(i + 1)
            return self.parens(i + 1) + (self.at(self.parens(i + 1)) == ";") if self.at(i) == "while" else i
        if t == "try":
            i = self.parens(i + 1) if self.at(i + 1) == "(" else i + 1
            i = self.block(i) if self.at(i) == "{" else i
            while self.at(i) in ("catch", "finally"):
                i = self.parens(i + 1) if self.at(i) == "catch" else i + 1
                i = self.block(i) if self.at(i) == "{" else i
            return i
        if self.at(i + 1) == ":" and t.isidentifier():
            return self.statement(i + 2)
        local = False
        while i < len(self.t) and self.t[i] not in (";", "}"):
            local |= self.t[i] in ("class", "interface", "enum")
            if self.t[i] == "(":
                i = self.parens(i)
            elif self.t[i] == "{":
                i = self.braces(i)
                if local:
                    return i
            else:
                i += 1
        return i + (self.at(i) == ";")


def statements(code: str) -> int:
    """Statements of a method's body: those standing in a block at any depth; bodies without braces do not count."""
    s = _Statements(code)
    depth = 0
    for i, t in enumerate(s.t):  # the body is the first brace outside of parentheses
        depth += (t == "(") - (t == ")")
        if t == "{" and not depth:
            s.block(i)
            break
        if t == ";" and not depth:
            break
    return s.n
