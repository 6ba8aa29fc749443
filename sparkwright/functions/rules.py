"""Ordered message rules as data, compiled into one CASE expression that whole-stage code generation covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other Errors"
ERROR_TYPES = ("Syntax Rule Violation", "Type Error", "Declaration Mismatch", "Undefined Symbols", "Duplicated Definitions", "Header File Error", OTHER)

#: (class, alternatives): the first class of which an alternative holds decides; a tuple's phrases must all occur, ^ asks for the beginning.
# Phrases of compiler messages.
RULES = [
    ("Header File Error", [
        "file not found", "no such file or directory", "#include nested too deeply",
    ]),
    ("Duplicated Definitions", [
        "redefinition of", "already has an initializer", "multiple definition", "redeclared as different kind of symbol",
    ]),
    ("Undefined Symbols", [
        "use of undeclared identifier", "unknown type name", "unknown class name", "no member named", "no template named", "unknown template name",
        "requires template arguments", "field has incomplete type", ("incomplete type", "used in"),
    ]),
    ("Declaration Mismatch", [
        "no matching function for call to", "no matching constructor for initialization", "is ambiguous", "marked 'override' but does not override",
        "does not override any member", "does not match any declaration", "different exception specification",
    ]),
    ("Type Error", [
        "no viable conversion", "no viable overloaded", "could not bind", "is not polymorphic", "invalid operands", "from incompatible type",
        "incompatible type", "cannot convert", "conversion from", "mismatched types", "initializing argument of type", ("return type", "must match"),
        "does not provide a call operator", ("implicitly-deleted", "constructor"), "is an abstract class", "abstract class type",
        "cannot initialize a variable of type", "comparison of distinct pointer types",
    ]),
    ("Undefined Symbols", [
        "implicit instantiation of undefined template", ("explicit instantiation of", "undefined template"), "incomplete type",
        "incomplete element type", "no type named",
    ]),
    ("Declaration Mismatch", [
        "is not a direct or virtual base of", "does not name a non-static data member", "tag type that does not match previous declaration",
        "no matching member function", "too few arguments to function call", "too many arguments to function call", "missing exception specification",
        "does not have a default constructor",
    ]),
    ("Duplicated Definitions", [
        "cannot be redeclared", "duplicate member",
    ]),
    ("Type Error", [
        "static_cast from", "cannot initialize a member subobject of type", "cannot initialize object parameter of type",
        "default initialization of an object of const type", "indirection requires pointer operand", "cannot form a reference to",
        "is not a constant expression", "no matching conversion", "cannot initialize a parameter of type", "cannot initialize return object",
        "cast from pointer to smaller type", "taking the address of a temporary", ("member reference type", "is not a pointer"), "dynamic_cast",
        "template argument for template type parameter must be a type",
    ]),
    ("Syntax Rule Violation", [
        "cannot be specified on member function templates", "illegal initializer", "does not look like a pure-specifier",
        "function definition is not allowed here", "not allowed inside a function", "extraneous closing brace", "unexpected character",
        "does not contain any unexpanded parameter packs", "definition of explicitly defaulted", "needs an explicit size or an initializer",
        "does not enclose namespace",
    ]),
    ("Declaration Mismatch", [
        "marked 'override' hides virtual member function", ("has a different return type", "override"),
    ]),
    ("Syntax Rule Violation", [
        "only virtual member functions can be marked", "does not allow dynamic exception specifications", "^expected", "expected class name",
        ("unexpected", "token"), ("unexpected", "end of file"),
    ]),
    ("Undefined Symbols", [
        "incomplete result type", "does not refer to a value", "cannot be implicitly captured", "is a private member of", "is a protected member of",
    ]),
    ("Declaration Mismatch", [
        ("return type of", "differs from"), ("return type of", "not covariant"), "more lax than base version", "call to deleted",
        "functions that differ only in their return type",
    ]),
    ("Duplicated Definitions", [
        "redeclared with", "typedef redefinition", "duplicate explicit instantiation",
    ]),
    ("Type Error", [
        "'this' argument to member function", "reference to 'void'", "may not have 'void'", "indirection not permitted",
        "address of an rvalue of type 'void'", "member reference base type 'void'", "static_cast", "reinterpret_cast", "cannot bind",
        "cannot initialize object parameter", "unrelated type", "_atomic cannot be applied", "static assertion failed",
        ("template arguments", "too many"), ("template arguments", "too few"), ("template arguments", "cannot have"),
        "must explicitly initialize the const member",
    ]),
    ("Syntax Rule Violation", [
        "pure-specifier", ("'virtual' ", "cannot be"), ("'virtual' ", "can only"), "'static' can only", "'override' specifier is not allowed",
        "not allowed in an identifier", "type specifier is required", "anonymous class", "forbids forward references", "templates can only be declared",
        "function definition is not allowed", "out-of-line declaration of a member", "range-based 'for'", "delegating constructor",
        "type-id cannot have a name", "parameter name cannot have template arguments", "brackets are not allowed", "type name requires a specifier",
    ]),
]
# Phrases of messages that follow from a missing header, and of the header errors themselves.
CASCADE = [
    "unknown type name",
    "unknown class name",
    "unknown template name",
    "incomplete type",
    "no member named",
    "marked 'override' but does not override",
    "does not override any member",
    "use of undeclared identifier",
    "requires template arguments",
    "no template named",
]
HEADER_ROOT = ("file not found", "#include nested too deeply")
# Kinds of issues of a diagnostic block; several may hold.
ISSUES = [
    ("missing_include", "file not found|No such file or directory"),
    ("incomplete_base_class", "base class has incomplete type"),
    ("forward_declare_insufficient", "incomplete type|invalid use of incomplete type"),
    ("invalid_override", "only virtual member functions can be marked 'override'|marked 'override' but does not override"),
    ("unknown_template", "no template named"),
    ("invalid_inheritance", "expected class name|expected class-name"),
    ("duplicate_definition", "redefinition of|multiple definition of"),
    ("template_or_syntax", "expected ';'|declaration does not declare anything"),
    ("unknown_type", "unknown type name|does not name a type"),
]
DEFAULT_ISSUE = "compile_error"


def rule_table() -> list[tuple[str, list[list[str]]]]:
    """(class, alternatives of phrases that must all occur), in order."""
    return [(name, [[alt] if isinstance(alt, str) else list(alt) for alt in alts]) for name, alts in RULES]


def issue_table() -> list[tuple[str, str]]:
    return ISSUES


def _holds(c: Column, phrase: str) -> Column:
    return c.startswith(phrase[1:]) if phrase[0] == "^" else c.contains(phrase)


def classify(message: Column) -> Column:
    """The class of a message; the first rule that matches decides. Null gives null."""
    low = F.lower(F.trim(message))
    case = None
    for name, alts in rule_table():
        hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_holds(low, p) for p in alt]) for alt in alts])
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return F.when(message.isNotNull(), case.otherwise(OTHER))


def cascade(message: Column, kind: Column) -> Column:
    """Whether a message follows from a missing header."""
    low = F.lower(message)
    return (kind != "Header File Error") & reduce(lambda a, b: a | b, [low.contains(p) for p in CASCADE])


def header_root(message: Column) -> Column:
    low = F.lower(message)
    return low.contains(HEADER_ROOT[0]) | low.contains(HEADER_ROOT[1])


def issue_types(block: Column) -> Column:
    """All kinds of issues of a block, in the table's order; the default kind if none holds."""
    found = F.filter(F.array(*[F.when(block.rlike("(?i)" + p), n) for n, p in issue_table()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_ISSUE)))


def error_lines(log: Column) -> Column:
    """The distinct error messages of a log in order, option tags and the note on too many errors taken off."""
    line = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_extract(F.trim(F.regexp_replace(x, "\r", "")), r"(?:fatal\s+)?error:\s*(.+?)\s*$", 1)), r"\s*\[-[^\]]+\]\s*$", ""))
    return F.array_distinct(F.filter(F.transform(F.split(log, "\n"), line), lambda m: (m != "") & ~m.contains("too many errors emitted")))
