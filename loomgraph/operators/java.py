"""The code graph from Java sources: entities, relationships and chunks of types.

Everything is found by expressions where a source is read; sources are never shuffled. Repeated rows (same id) give equal
results, which are made unique at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import java as j
from loomgraph.functions.text import PRIMITIVES


def _named(kind: str, targets: Column, name: str = "target") -> Column:
    """array<struct<kind, name>> of an array of targets."""
    return F.transform(targets, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias(name)))


def _declared(classes: DataFrame) -> DataFrame:
    """id, owner (full name), class_type, package, imports, code, and each declaration with its place: one row each."""
    code = classes.filter("source_code <> ''").select("id", "fully_qualified_name", "package_name", "class_type", j.imports(F.col("source_code")).alias("imports"), j.plain_code(F.col("source_code")).alias("code"))
    rows = code.withColumn("declarations", j.declarations(F.col("code")))
    return rows.select("id", "fully_qualified_name", "package_name", "class_type", "imports", F.posexplode("declarations").alias("place", "text"))


def entities(classes: DataFrame) -> DataFrame:
    """class_id, place, kind (METHOD, CONSTRUCTOR, FIELD, TYPE, CONSTANTS), name, type, has_body of all members of types.

    ``classes``: id, fully_qualified_name, package_name, class_type, source_code. Empty sources give nothing.
    """
    first = (F.lower("class_type") == "enum") & (F.col("place") == 0)
    rows = _declared(classes).select(F.col("id").alias("class_id"), "place", F.inline(F.array(j.member(F.col("text"), F.coalesce(first, F.lit(False))))))
    return rows.filter("kind is not null and name <> ''").dropDuplicates(["class_id", "place"])


def relationships(classes: DataFrame) -> DataFrame:
    """source_id, kind, target, each once: HAS_METHOD, HAS_FIELD, HAS_CONSTRUCTOR (target: the member's name), TYPE_DEPENDENCY
    (types of fields), EXTENDS, IMPLEMENTS, CALLS (target: ``METHOD:`` and the simple name, unresolved) and INSTANTIATES.
    """
    has = F.create_map(*(F.lit(x) for k in ("METHOD", "FIELD", "CONSTRUCTOR") for x in (k, f"HAS_{k}")))
    members = entities(classes)
    own = members.filter(F.col("kind").isin("METHOD", "FIELD", "CONSTRUCTOR")).select(F.col("class_id").alias("source_id"), has[F.col("kind")].alias("kind"), F.col("name").alias("target"))
    typed = members.filter("kind = 'FIELD'").select(F.col("class_id").alias("source_id"), F.lit("TYPE_DEPENDENCY").alias("kind"), j.element_type(F.col("type"))["type"].alias("target"))
    code = classes.filter("source_code <> ''").select(F.col("id").alias("source_id"), j.plain_code(F.col("source_code")).alias("code"))
    calls = F.transform(j.called_methods(F.col("code")), lambda c: F.concat(F.lit("METHOD:"), F.substring_index(c, ".", -1)))
    found = [("EXTENDS", j.super_types(F.col("code"), "extends")), ("IMPLEMENTS", j.super_types(F.col("code"), "implements")), ("CALLS", calls), ("INSTANTIATES", j.made_types(F.col("code")))]
    pairs = F.flatten(F.array(*(_named(kind, targets) for kind, targets in found)))
    rows = own.unionByName(typed.filter(~F.col("target").isin(*PRIMITIVES, ""))).unionByName(code.select("source_id", F.inline(pairs)))
    return rows.distinct()


def rich_dependencies(classes: DataFrame) -> DataFrame:
    """source_id, kind, target (full name), cardinality, each once: INJECTS (fields, parameters of constructors), RETURNS, ACCEPTS, THROWS,
    EXTENDS and IMPLEMENTS. Primitives and the type itself are left out; collections count as their elements.
    """
    first = F.coalesce((F.lower("class_type") == "enum") & (F.col("place") == 0), F.lit(False))
    rows = _declared(classes).withColumn("m", j.member(F.col("text"), first))
    throws = F.regexp_extract_all(F.regexp_extract("text", r"\bthrows ([\w., ]+)", 1), F.lit(r"([\w.]+)"), F.lit(1))
    kind, parameters = F.col("m.kind"), j.parameter_types(F.col("text"))
    of = lambda when, name, types: _named(name, F.when(when, types).otherwise(F.array().cast("array<string>")), "t")
    found = F.flatten(F.array(of(kind == "FIELD", "INJECTS", F.array("m.type")), of(kind == "CONSTRUCTOR", "INJECTS", parameters), of(kind == "METHOD", "RETURNS", F.array("m.type")), of(kind == "METHOD", "ACCEPTS", parameters), of(kind.isin("METHOD", "CONSTRUCTOR"), "THROWS", throws)))
    used = rows.select("id", "fully_qualified_name", "package_name", "imports", F.inline(found))
    code = classes.filter("source_code <> ''").select("id", "fully_qualified_name", "package_name", j.imports(F.col("source_code")).alias("imports"), j.plain_code(F.col("source_code")).alias("code"))
    above = F.flatten(F.array(*(_named(k, j.super_types(F.col("code"), w), "t") for k, w in (("EXTENDS", "extends"), ("IMPLEMENTS", "implements")))))
    both = used.unionByName(code.select("id", "fully_qualified_name", "package_name", "imports", F.inline(above)))
    typed = both.withColumn("e", j.element_type(F.col("t"))).filter(~F.col("e.type").isin(*PRIMITIVES, ""))
    target = j.resolve_fqn(F.col("e.type"), F.col("imports"), F.col("package_name"))
    return typed.select(F.col("id").alias("source_id"), "kind", target.alias("target"), F.col("e.cardinality").alias("cardinality"), "fully_qualified_name").filter("target <> coalesce(fully_qualified_name, '')").drop("fully_qualified_name").distinct()


def chunks(classes: DataFrame) -> DataFrame:
    """chunk_id, parent_id, chunk_type, name: a chunk for each type, and one for each of its methods, constructors and fields."""
    types = classes.select(F.col("id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("CLASS").alias("chunk_type"), "name")
    parts = entities(classes).filter(F.col("kind").isin("METHOD", "FIELD", "CONSTRUCTOR"))
    suffix = F.when(F.col("kind") == "FIELD", F.concat("name", F.lit("_field"))).otherwise(F.col("name"))
    return types.distinct().unionByName(parts.select(F.concat_ws(".", "class_id", suffix, "place").alias("chunk_id"), F.col("class_id").alias("parent_id"), F.col("kind").alias("chunk_type"), "name"))


def members_of(relationships: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """class_id, class_name, member: typed edges joined with the types they leave."""
    return relationships.filter(F.col("kind") == kind).join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("class_name")), "source_id").select(F.col("source_id").alias("class_id"), "class_name", F.col("target").alias("member"))


def callers(calls: DataFrame, members: DataFrame) -> DataFrame:
    """callee (class and member), caller_id, each once: unresolved calls (source_id, target METHOD:<name>) joined to the members of that name."""
    named = members.select(F.concat(F.lit("METHOD:"), F.col("member")).alias("target"), F.concat_ws(".", "class_name", "member").alias("callee"))
    return calls.join(named, "target").select("callee", F.col("source_id").alias("caller_id")).distinct()


def two_hops(relationships: DataFrame, nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """source_id, target, each once: what a type depends on over one or two edges of these kinds; targets are simple names, the second hop leaves the type of that name."""
    one = relationships.filter(F.col("kind").isin(*kinds)).select("source_id", "target").distinct()
    at = nodes.select(F.col("id").alias("_id"), F.col("name").alias("target")).join(one.select(F.col("source_id").alias("_id"), F.col("target").alias("_next")), "_id")
    return one.unionByName(one.join(at, "target").select("source_id", F.col("_next").alias("target"))).distinct()


def context_files(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """file, types, dependencies, subclasses and confidence: each file with its types, how many types they depend on and how many extend them; confidence is the share of types that something is known of."""
    n_deps = relationships.filter(F.col("kind").isin("TYPE_DEPENDENCY", "EXTENDS", "IMPLEMENTS")).groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target").alias("deps"))
    n_subs = relationships.filter("kind = 'EXTENDS'").groupBy(F.col("target").alias("name")).agg(F.countDistinct("source_id").alias("subs"))
    rows = nodes.join(n_deps, "id", "left").join(n_subs, "name", "left")
    known = F.count_if((F.coalesce("deps", F.lit(0)) > 0) | (F.coalesce("subs", F.lit(0)) > 0))
    return rows.groupBy("file").agg(
        F.count("*").alias("types"), F.coalesce(F.sum("deps"), F.lit(0)).alias("dependencies"), F.coalesce(F.sum("subs"), F.lit(0)).alias("subclasses"),
        F.round(F.try_divide(known, F.count("*")), 4).alias("confidence"),
    )


def has_library(imports: Column, base: str) -> Column:
    """Does any of the imports begin with the package ``base``, whole segments compared?"""
    return F.coalesce(F.exists(imports, lambda i: (i == base) | i.startswith(base + ".")), F.lit(False))
