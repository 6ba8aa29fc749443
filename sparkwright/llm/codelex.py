"""Comments and literals of source texts, found in one pass and recovering at line ends.

An unclosed string ends at its line's end. An unclosed block comment ends before the next line that looks
like code again, else with the text.
"""

from __future__ import annotations

import re

_SPAN = re.compile(
    r'"""(?:\\.|[^\\])*?"""'
    r'|R"(?P<d>[^()\\\s"]{0,16})\((?:.|\n)*?\)(?P=d)"'
    r"|/\*(?:(?!\*/)[^\0])*?\*/"
    r"|//[^\n]*"
    r'|"(?:\\[^\n]|[^"\\\n])*"?'
    r"|'(?:\\[^\n]{1,6}|[^'\\\n])'"
    r"|/\*"
)
_CODE_LINE = re.compile(r"\n(?=[ \t]*(?:@\w+|(?:public|private|protected|static|final|virtual|class|interface|enum|import|package|return|if|for|while)\b|[^\n*]*[;{}][ \t]*(?:\r?\n|\Z)))")
_ESCAPE = re.compile(r"\\(?:u+([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(.))", re.S)
# Single-letter escapes.
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "s": " ", "a": "\a", "v": "\v"}


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of comments ``b`` (block) and ``l`` (line) and of literals ``s``; character literals are passed over."""
    out = []
    pos, search = 0, _SPAN.search
    while m := search(text, pos):
        a, b = m.span()
        c = text[a : a + 2]
        if c == "/*" and b - a == 2:  # unclosed
            n = _CODE_LINE.search(text, a)
            b = n.start() if n else len(text)
            out.append(("b", a, b))
        elif c == "/*":
            out.append(("b", a, b))
        elif c == "//":
            out.append(("l", a, b))
        elif c[0] != "'":
            out.append(("s", a, b))
        pos = max(b, a + 1)
    return out


def own_line(text: str, start: int) -> bool:
    """Only white space stands before ``start`` on its line."""
    line = text.rfind("\n", 0, start) + 1
    return not text[line:start].strip(" \t\r﻿")


def merged(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[int, int]]]]:
    """(kind, parts): line comments in a row become one; literals joined by + or by nothing but white space become one."""
    out: list[tuple[str, list[tuple[int, int]]]] = []
    for kind, a, b in found:
        if out and out[-1][0] == kind and kind in "ls":
            between = text[out[-1][1][-1][1] : a]
            # a comment that ends a code line begins nothing and continues nothing
            if kind == "l" and not between.strip() and between.count("\n") == 1 and own_line(text, a) and own_line(text, out[-1][1][-1][0]):
                out[-1][1].append((a, b))
                continue
            if kind == "s" and len(between) < 200 and between.strip() in ("+", ""):
                out[-1][1].append((a, b))
                continue
        out.append((kind, [(a, b)]))
    return out


def unescape(s: str) -> str:
    """A literal's characters; surrogate pairs written as two escapes are joined."""
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        u, big, x, octal, simple = m.groups()
        if simple is not None:
            return _SIMPLE.get(simple, simple)
        try:
            return chr(int(u or big or x, 16) if not octal else int(octal, 8))
        except (ValueError, OverflowError):
            return " "

    out = _ESCAPE.sub(one, s)
    try:
        return out.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_STAR = re.compile(r"(?m)^[ \t]*\*(?!/)[ \t]?|\r")


def comment_body(raw: str) -> str:
    """A comment's text without its marks."""
    if raw.startswith("/*"):
        raw = raw[2:-2] if raw.endswith("*/") and len(raw) > 3 else raw[2:]
        return _STAR.sub("", raw.lstrip("*!").rstrip("*"))
    return raw.lstrip("/").lstrip("!").strip("\r")


def literal_body(raw: str) -> str:
    if raw.startswith('"""'):
        return unescape(raw[3:-3])
    if raw.startswith('R"'):
        return raw[raw.find("(") + 1 : raw.rfind(")")]
    return unescape(raw[1:-1] if raw.endswith('"') and len(raw) > 1 else raw[1:])
