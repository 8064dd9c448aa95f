"""Column functions on Java sources: what a type declares, extends, calls and makes, in regular expressions of the JVM.

Strings, comments and annotations are blanked first. A type's body is then reduced to its own members: the innermost blocks
are replaced by ``#;`` again and again, until none is left; what remains are the declarations, each with ``#`` if it has a
body. Members of nested types belong to that type and are not told; a source that ends within a body gives the member with
what is there; a null source gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import COLLECTIONS, PRIMITIVES

#: strings, text blocks, characters and comments
SKIPPED = r'"""[\s\S]*?"""|/\*[\s\S]*?\*/|//[^\n]*|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|' + r"'(?:\\.|[^'\\\n])'"
ANNOTATION = r"@[A-Za-z][\w.]*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?"
BLOCK = r"\{[^{}]*\}"
MODIFIERS = r"^(?:(?:public|protected|private|static|final|abstract|default|synchronized|native|strictfp|transient|volatile)\s+)+"
TYPE_PARAMETERS = r"^<.*?>\s+"
IS_TYPE = r"(?:^|\s)(?:class|interface|enum|record)\s+\w+"
PARAMETER = r"(?:final\s+)?([\w.$]+(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?(?:\[\])*)(?:\.\.\.)?\s+[\w$]+\s*(?:,|\))"
IMPORT = r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)\s*;"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_code(source: Column) -> Column:
    """The source without the content of strings, comments and annotations."""
    return F.regexp_replace(F.regexp_replace(source, SKIPPED, " "), ANNOTATION, " ")


def header(code: Column) -> Column:
    """What stands before the first brace of plain code, with single blanks."""
    return F.regexp_replace(F.substring_index(code, "{", 1), r"\s+", " ")


def declarations(code: Column) -> Column:
    """The members of the first type in plain code as texts (array<string>), those with a body ending in ``#``."""
    body = F.when(F.contains(code, F.lit("{")), F.regexp_replace(code, r"^[^{]*\{", ""))
    depth = lambda b: F.greatest(F.length(b) - F.length(F.replace(b, F.lit("{"), F.lit(""))), F.lit(1))  # noqa: E731  # no block is nested deeper than there are braces
    flat = _let(body, lambda b: F.aggregate(F.sequence(F.lit(1), depth(b)), b, lambda t, _: F.when(F.contains(t, F.lit("}")), F.regexp_replace(t, BLOCK, "#;")).otherwise(t)))
    own = F.regexp_replace(F.substring_index(flat, "}", 1), r"\{[\s\S]*$", "#;")
    return F.filter(F.transform(F.split(own, ";"), lambda m: F.trim(F.regexp_replace(m, r"\s+", " "))), lambda m: ~m.isin("", "#"))


def member(text: Column, first_of_enum: Column) -> Column:
    """struct<kind, name, type, has_body> of a declaration; kind METHOD, CONSTRUCTOR, FIELD, TYPE or CONSTANTS, null for what is none."""
    head = F.rtrim(F.regexp_replace(text, r"\s*#$", ""))
    declared = F.trim(F.substring_index(head, "=", 1))
    callable_ = F.contains(declared, F.lit("("))
    is_type = declared.rlike(IS_TYPE) & ~callable_ | declared.rlike(r"(?:^|\s)record\s+\w+\s*[(<]")
    name = F.when(is_type, F.regexp_extract(declared, r"(?:class|interface|enum|record)\s+(\w+)", 1)).when(callable_, F.regexp_extract(declared, r"([\w$]+)\s*\(", 1)).otherwise(F.regexp_extract(declared, r"([\w$]+)(?:\s*\[\])*$", 1))
    before = F.when(callable_, F.regexp_replace(declared, r"[\w$]+\s*\([\s\S]*$", "")).otherwise(F.regexp_replace(declared, r"[\w$]+((?:\s*\[\])*)$", "$1"))
    type_ = F.trim(F.regexp_replace(F.regexp_replace(before, MODIFIERS, ""), TYPE_PARAMETERS, ""))
    kind = (
        F.when(~declared.rlike(r"^[\w<$]"), None).when(first_of_enum, "CONSTANTS").when(is_type, "TYPE").when(callable_ & (type_ == ""), "CONSTRUCTOR").when(callable_, "METHOD").when((type_ != "") & ~type_.rlike(r"^(?:static|import|package)$"), "FIELD")
    )
    return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind.isin("METHOD", "FIELD"), type_).otherwise("").alias("type"), (text.endswith("#") & kind.isin("METHOD", "CONSTRUCTOR", "TYPE")).alias("has_body"))


def parameter_types(text: Column) -> Column:
    """Types of the parameters of a declaration (array<string>)."""
    return F.regexp_extract_all(F.regexp_extract(text, r"(\([^=]*\))", 1), F.lit(PARAMETER), F.lit(1))


def called_methods(code: Column) -> Column:
    """Distinct ``target.method`` of the calls in plain code, those of targets with less than 50 characters."""
    return F.filter(F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_$][\w$]*\.[\w$]+)\s*\("), F.lit(1))), lambda c: F.length(c) < 50)


def made_types(code: Column) -> Column:
    """Distinct types of which plain code makes instances."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"\bnew\s+([A-Z][\w.]*)"), F.lit(1)))


def super_types(code: Column, word: str) -> Column:
    """The types named after ``extends`` or ``implements`` in the header of plain code, without their parameters."""
    plain = _let(header(code), lambda h: F.regexp_replace(F.regexp_replace(h, r"<[^<>]*>", ""), r"<[^<>]*>", ""))
    return F.regexp_extract_all(F.regexp_extract(plain, rf"\b{word} ([\w., ]+?)(?: implements | permits | *$)", 1), F.lit(r"([\w.]+)"), F.lit(1))


def imports(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(IMPORT), F.lit(1))


def resolve_type(name: Column, package: Column) -> Column:
    """A dotted name as it is, a primitive as that of java.lang, any other one within the package."""
    return F.when(F.contains(name, F.lit(".")), name).when(name.isin(*(p for p in PRIMITIVES if p != "void")), F.concat(F.lit("java.lang."), name)).otherwise(F.concat_ws(".", F.nullif(package, F.lit("")), name))


def resolve_fqn(name: Column, imported: Column, package: Column) -> Column:
    """A dotted name as it is, else the import that ends in it, else the name within the package, but for the everyday types of java.lang."""
    found = F.get(F.filter(imported, lambda i: i.endswith(F.concat(F.lit("."), name))), F.lit(0))
    own = F.when(name.isin("String", "Integer", "Object"), name).otherwise(F.concat_ws(".", F.nullif(package, F.lit("")), name))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.coalesce(found, own))


def class_name_from_code(source: Column) -> Column:
    """Package and name of the first public type of a source; '' where there is none."""
    name = F.regexp_extract(source, r"public\s+(?:(?:abstract|final|static|sealed)\s+)*(?:class|interface|enum)\s+(\w+)", 1)
    package = F.regexp_extract(source, r"(?m)^[ \t]*package\s+([\w.]+)\s*;", 1)
    return F.when((name != "") & (package != ""), F.concat(package, F.lit("."), name)).otherwise(name)


def class_from_chunk_id(chunk: Column) -> Column:
    """The class of a chunk's id ``repo:package.Class[.member]``: a last part in lower case or ending in _field is a member. Less than two parts: null."""
    parts = F.split(F.regexp_replace(chunk, r"^[^:]*:", ""), r"\.")
    last = F.element_at(parts, -1)
    is_member = last.rlike(r"^[a-z]") | last.endswith("_field")
    return F.when(F.size(parts) >= 2, F.array_join(F.when(is_member, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), "."))


def element_type(name: Column) -> Column:
    """struct<type, cardinality>: of collections the element (MANY), of Optional its element and of others the type itself (ONE)."""
    outer, inner = F.regexp_extract(name, r"^\s*([\w.$]+)", 1), F.regexp_extract(name, r"<\s*(?:\?\s+(?:extends|super)\s+)?([\w.$]+)", 1)
    many = outer.isin(*COLLECTIONS)
    return F.struct(F.when((many | (outer == "Optional")) & (inner != ""), inner).otherwise(outer).alias("type"), F.when(many | name.endswith("[]"), "MANY").otherwise("ONE").alias("cardinality"))
