"""The classes of compiler messages and the issues of diagnostic blocks in SQL, written by themselves and not from the tables of ``functions.rules``.

The first WHEN that holds decides. Fixed values: the phrases.
"""

_CLASSES = """CASE
  WHEN regexp_matches({x}, 'file not found|no such file or directory|#include nested too deeply') THEN 'Header File Error'
  WHEN regexp_matches({x}, 'redefinition of|already has an initializer|multiple definition|redeclared as different kind of symbol') THEN 'Duplicated Definitions'
  WHEN regexp_matches({x}, 'use of undeclared identifier|unknown (type|class) name|no member named|no template named|unknown template name|requires template arguments|field has incomplete type') OR ({x} LIKE '%incomplete type%' AND {x} LIKE '%used in%') THEN 'Undefined Symbols'
  WHEN regexp_matches({x}, 'no matching function for call to|no matching constructor for initialization|is ambiguous|marked ''override'' but does not override|does not override any member|does not match any declaration|different exception specification') THEN 'Declaration Mismatch'
  WHEN regexp_matches({x}, 'no viable conversion|no viable overloaded|could not bind|is not polymorphic|invalid operands|incompatible type|cannot convert|conversion from|mismatched types|initializing argument of type|does not provide a call operator|is an abstract class|abstract class type|cannot initialize a variable of type|comparison of distinct pointer types')
    OR ({x} LIKE '%return type%' AND {x} LIKE '%must match%') OR ({x} LIKE '%implicitly-deleted%' AND {x} LIKE '%constructor%') THEN 'Type Error'
  WHEN regexp_matches({x}, 'implicit instantiation of undefined template|incomplete type|incomplete element type|no type named') OR ({x} LIKE '%explicit instantiation of%' AND {x} LIKE '%undefined template%') THEN 'Undefined Symbols'
  WHEN regexp_matches({x}, 'is not a direct or virtual base of|does not name a non-static data member|tag type that does not match previous declaration|no matching member function|too (few|many) arguments to function call|missing exception specification|does not have a default constructor') THEN 'Declaration Mismatch'
  WHEN regexp_matches({x}, 'cannot be redeclared|duplicate member') THEN 'Duplicated Definitions'
  WHEN regexp_matches({x}, 'static_cast from|cannot initialize a member subobject of type|cannot initialize object parameter of type|default initialization of an object of const type|indirection requires pointer operand|cannot form a reference to|is not a constant expression|no matching conversion|cannot initialize a parameter of type|cannot initialize return object|cast from pointer to smaller type|taking the address of a temporary|dynamic_cast|template argument for template type parameter must be a type')
    OR ({x} LIKE '%member reference type%' AND {x} LIKE '%is not a pointer%') THEN 'Type Error'
  WHEN regexp_matches({x}, 'cannot be specified on member function templates|illegal initializer|does not look like a pure-specifier|function definition is not allowed here|not allowed inside a function|extraneous closing brace|unexpected character|does not contain any unexpanded parameter packs|definition of explicitly defaulted|needs an explicit size or an initializer|does not enclose namespace') THEN 'Syntax Rule Violation'
  WHEN {x} LIKE '%marked ''override'' hides virtual member function%' OR ({x} LIKE '%has a different return type%' AND {x} LIKE '%override%') THEN 'Declaration Mismatch'
  WHEN regexp_matches({x}, 'only virtual member functions can be marked|does not allow dynamic exception specifications|^expected|expected class name') OR ({x} LIKE '%unexpected%' AND regexp_matches({x}, 'token|end of file')) THEN 'Syntax Rule Violation'
  WHEN regexp_matches({x}, 'incomplete result type|does not refer to a value|cannot be implicitly captured|is a (private|protected) member of') THEN 'Undefined Symbols'
  WHEN regexp_matches({x}, 'more lax than base version|call to deleted|functions that differ only in their return type') OR ({x} LIKE '%return type of%' AND regexp_matches({x}, 'differs from|not covariant')) THEN 'Declaration Mismatch'
  WHEN regexp_matches({x}, 'redeclared with|typedef redefinition|duplicate explicit instantiation') THEN 'Duplicated Definitions'
  WHEN regexp_matches({x}, '''this'' argument to member function|reference to ''void''|may not have ''void''|indirection not permitted|address of an rvalue of type ''void''|member reference base type ''void''|static_cast|reinterpret_cast|cannot bind|cannot initialize object parameter|unrelated type|_atomic cannot be applied|static assertion failed|must explicitly initialize the const member')
    OR ({x} LIKE '%template arguments%' AND regexp_matches({x}, 'too many|too few|cannot have')) THEN 'Type Error'
  WHEN regexp_matches({x}, 'pure-specifier|''static'' can only|''override'' specifier is not allowed|not allowed in an identifier|type specifier is required|anonymous class|forbids forward references|templates can only be declared|function definition is not allowed|out-of-line declaration of a member|range-based ''for''|delegating constructor|type-id cannot have a name|parameter name cannot have template arguments|brackets are not allowed|type name requires a specifier')
    OR ({x} LIKE '%''virtual'' %' AND regexp_matches({x}, 'cannot be|can only')) THEN 'Syntax Rule Violation'
  ELSE 'Other Errors' END"""

#: Whether a message follows from a missing header.
CASCADE = "regexp_matches(lower({m}), 'unknown type name|unknown class name|unknown template name|incomplete type|no member named|marked ''override'' but does not override|does not override any member|use of undeclared identifier|requires template arguments|no template named')"

_ISSUES = [
    ("missing_include", "regexp_matches({b}, '(?i)fatal error: ''([^'']+)'' file not found|no such file or directory|file not found')"),
    ("incomplete_base_class", "regexp_matches({b}, '(?i)base class has incomplete type')"),
    ("forward_declare_insufficient", "regexp_matches({b}, '(?i)incomplete type')"),
    ("invalid_override", "regexp_matches({b}, '(?i)only virtual member functions can be marked ''override''|marked ''override'' but does not override')"),
    ("unknown_template", "regexp_matches({b}, '(?i)no template named')"),
    ("invalid_inheritance", "regexp_matches({b}, '(?i)expected class[ -]name')"),
    ("duplicate_definition", "regexp_matches({b}, '(?i)redefinition of|multiple definition of')"),
    ("template_or_syntax", "regexp_matches({b}, '(?i)expected '';''|declaration does not declare anything')"),
    ("unknown_type", "regexp_matches({b}, '(?i)unknown type name|does not name a type')"),
]


def classes(message: str) -> str:
    """The class of a message column."""
    return f"CASE WHEN {message} IS NOT NULL THEN {_CLASSES.replace('{x}', f'lower(trim({message}))')} END"


def cascade(message: str) -> str:
    return CASCADE.replace("{m}", message)


def issues(block: str) -> str:
    """The list of a block's issues; without any, that it is an error."""
    found = "list_filter([" + ", ".join(f"CASE WHEN {test.replace('{b}', block)} THEN '{name}' END" for name, test in _ISSUES) + "], lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['compile_error'] END"
