"""Column functions on queries, names, types, addresses and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from this that these those is are was were be been being do does did have has had what which who where when why how".split()
)
PRIMITIVES = ("void", "boolean", "byte", "char", "short", "int", "long", "float", "double")
COLLECTIONS = ("List", "Set", "Collection", "Iterable", "Stream")


def tokenize_query(text: Column) -> Column:
    """Words in lower case, letters and digits only, longer than two, without stop words; order and repeats are kept."""
    words = F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


# 3, 2 and 1 points, and .5 without keywords.
def keyword_score(keywords: list[str], name: Column, fqn: Column, source: Column) -> Column:
    """Each keyword counts 3 in the name, else 2 in the full name, else 1 in the source; as a share of the most possible. .5 without keywords."""
    if not keywords:
        return F.lit(0.5)
    has = lambda c, k: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k))
    points = sum((F.when(has(name, k), 3).when(has(fqn, k), 2).when(has(source, k), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.least(F.lit(1.0), points / (3.0 * len(keywords)))


# The words that tell the mode.
def search_mode(query: Column) -> Column:
    """STRUCTURAL, TEMPORAL or SEMANTIC by the words of a query; the first rule that fits holds."""
    low = F.lower(query)
    return F.when(low.rlike("call|depend|extend|implement|relationship"), "STRUCTURAL").when(low.rlike("change|history|recent|modified|commit"), "TEMPORAL").otherwise("SEMANTIC")


def package_of(fqn: Column) -> Column:
    """What stands before the last dot, '' if there is none or the name is null."""
    return F.regexp_extract(F.coalesce(fqn, F.lit("")), r"^(.*)\.[^.]*$", 1)


def simple_type(name: Column) -> Column:
    """struct<type, many>: the element type of collections (many) and of Optional, any other type without its parameters."""
    outer = F.regexp_extract(name, r"^\s*([\w.$]+)", 1)
    inner = F.regexp_extract(name, r"<\s*([\w.$]+)", 1)
    many = outer.isin(*COLLECTIONS) | name.endswith("[]")
    return F.struct(F.when((outer.isin(*COLLECTIONS) | (outer == "Optional")) & (inner != ""), inner).otherwise(outer).alias("type"), many.alias("many"))


def repository(url: Column) -> Column:
    """host/path of a repository address in any of its forms (https, ssh, scp-like; with or without .git or a slash), null if it is none."""
    plain = F.regexp_replace(F.lower(F.btrim(url, F.lit(" \t"))), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^([^/:]+):(?:\d+/)?", "$1/"), r"[?#].*$", "")
    plain = F.regexp_replace(plain, r"/*(?:\.git)?/*$", "")
    return F.when(F.contains(plain, F.lit("/")), plain)


def strip_code_fence(text: Column) -> Column:
    """The text without a fence around the whole of it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
