"""The code graph of the Java sources: entities, relationships, and what joins them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import java as j
from loomgraph.functions.text import COLLECTIONS, PRIMITIVES
from loomgraph.operators import graph as g
from loomgraph.operators import java as o
from loomgraph.operators.retrieval import prefix_join
from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _flat(times: int) -> str:
    out = "b"
    for _ in range(times):
        out = f"regexp_replace({out}, {_text(j.BLOCK)}, '#;', 'g')"
    return out


_TYPE = f"trim(regexp_replace(regexp_replace(before, {_text(j.MODIFIERS)}, ''), {_text(j.TYPE_PARAMETERS)}, ''))"
_OUTER, _INNER = r"regexp_extract({0}, '^\s*([\w.$]+)', 1)", r"regexp_extract({0}, '<\s*(?:\?\s+(?:extends|super)\s+)?([\w.$]+)', 1)"
_ELEMENT = f"CASE WHEN ({_OUTER} IN {_in(COLLECTIONS)} OR {_OUTER} = 'Optional') AND {_INNER} <> '' THEN {_INNER} ELSE {_OUTER} END"
_CARDINALITY = f"CASE WHEN {_OUTER} IN {_in(COLLECTIONS)} OR {{0}} LIKE '%[]' THEN 'MANY' ELSE 'ONE' END"
_SUPER = r"""regexp_extract_all(regexp_extract(regexp_replace(regexp_replace(regexp_replace(split_part(code, '{{', 1), '\s+', ' ', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '\b{0} ([\w., ]+?)(?: implements | permits | *$)', 1), '([\w.]+)', 1)"""
_CALLED = r"list_filter(list_distinct(regexp_extract_all(code, '\b([A-Za-z_$][\w$]*\.[\w$]+)\s*\(', 1)), lambda c: length(c) < 50)"

_CTE = f"""WITH RECURSIVE src AS (SELECT DISTINCT id, name, fully_qualified_name, package_name, class_type, source_file_path AS file, source_code FROM classes),
code AS (SELECT *, regexp_extract_all(source_code, {_text(j.IMPORT)}, 1) AS imports, regexp_replace(regexp_replace(source_code, {_text(j.SKIPPED)}, ' ', 'g'), {_text(j.ANNOTATION)}, ' ', 'g') AS code FROM src WHERE source_code <> ''),
flat AS (SELECT *, {_flat(14)} AS f FROM (SELECT *, regexp_replace(code, '^[^{{]*\\{{', '') AS b FROM code WHERE contains(code, '{{')) b),
lists AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(split_part(f, '}}', 1), '\\{{[\\s\\S]*$', '#;'), ';'), lambda m: trim(regexp_replace(m, '\\s+', ' ', 'g'))), lambda m: m NOT IN ('', '#')) AS l FROM flat),
decl AS (SELECT *, l[place + 1] AS text, lower(class_type) = 'enum' AND place = 0 AS first FROM (SELECT id, fully_qualified_name, package_name, class_type, imports, l, unnest(range(len(l))) AS place FROM lists) p),
heads AS (SELECT *, trim(split_part(rtrim(regexp_replace(text, '\\s*#$', '')), '=', 1)) AS declared FROM decl),
parts AS (SELECT *, contains(declared, '(') AS callable, (regexp_matches(declared, {_text(j.IS_TYPE)}) AND NOT contains(declared, '(')) OR regexp_matches(declared, '(?:^|\\s)record\\s+\\w+\\s*[(<]') AS is_type,
  CASE WHEN contains(declared, '(') THEN regexp_replace(declared, '[\\w$]+\\s*\\([\\s\\S]*$', '') ELSE regexp_replace(declared, '[\\w$]+((?:\\s*\\[\\])*)$', '\\1') END AS before FROM heads),
kinds AS (SELECT *, CASE WHEN NOT regexp_matches(declared, '^[\\w<$]') THEN NULL WHEN first THEN 'CONSTANTS' WHEN is_type THEN 'TYPE' WHEN callable AND {_TYPE} = '' THEN 'CONSTRUCTOR' WHEN callable THEN 'METHOD' WHEN {_TYPE} NOT IN ('', 'static', 'import', 'package') THEN 'FIELD' END AS kind,
  CASE WHEN is_type THEN regexp_extract(declared, '(?:class|interface|enum|record)\\s+(\\w+)', 1) WHEN callable THEN regexp_extract(declared, '([\\w$]+)\\s*\\(', 1) ELSE regexp_extract(declared, '([\\w$]+)(?:\\s*\\[\\])*$', 1) END AS name FROM parts),
ent AS (SELECT id AS class_id, place, kind, name, CASE WHEN kind IN ('METHOD', 'FIELD') THEN {_TYPE} ELSE '' END AS type, text LIKE '%#' AND kind IN ('METHOD', 'CONSTRUCTOR', 'TYPE') AS has_body, text, fully_qualified_name, package_name, imports FROM kinds WHERE kind IS NOT NULL AND name <> ''),
rel AS (SELECT DISTINCT * FROM (SELECT class_id AS source_id, 'HAS_' || kind AS kind, name AS target FROM ent WHERE kind IN ('METHOD', 'FIELD', 'CONSTRUCTOR')
  UNION ALL SELECT class_id, 'TYPE_DEPENDENCY', {_ELEMENT.format("type")} FROM ent WHERE kind = 'FIELD'
  UNION ALL SELECT id, 'EXTENDS', unnest({_SUPER.format("extends")}) FROM code UNION ALL SELECT id, 'IMPLEMENTS', unnest({_SUPER.format("implements")}) FROM code
  UNION ALL SELECT id, 'CALLS', 'METHOD:' || split_part(unnest({_CALLED}), '.', -1) FROM code
  UNION ALL SELECT id, 'INSTANTIATES', unnest(list_distinct(regexp_extract_all(code, '\\bnew\\s+([A-Z][\\w.]*)', 1))) FROM code) u WHERE kind <> 'TYPE_DEPENDENCY' OR target NOT IN {_in((*PRIMITIVES, ""))})
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _CTE + sql
        return f

    return add


def _classes(spark, d):
    return table(spark, d, "classes", "id", "name", "fully_qualified_name", "package_name", "class_type", "source_file_path", "source_code", "super_class_name", "interfaces")


def _nodes(spark, d):
    return table(spark, d, "classes", "id", "name", F.col("source_file_path").alias("file")).distinct()


@query("SELECT class_id, place, kind, name, type, has_body FROM ent")
def extract_entities(spark, d):
    return o.entities(_classes(spark, d))


@query("SELECT source_id, kind, target FROM rel")
def extract_relationships(spark, d):
    return o.relationships(_classes(spark, d))


_RESOLVE = "CASE WHEN contains(t, '.') THEN t ELSE coalesce(list_filter(imports, lambda i: i LIKE '%.' || t)[1], CASE WHEN t IN ('String', 'Integer', 'Object') THEN t ELSE concat_ws('.', nullif(package_name, ''), t) END) END"
_PARAMETERS = f"regexp_extract_all(regexp_extract(text, '(\\([^=]*\\))', 1), {_text(j.PARAMETER)}, 1)"


@query(f"""SELECT DISTINCT source_id, kind, target, cardinality FROM (SELECT source_id, kind, {_RESOLVE} AS target, cardinality, fqn FROM (
  SELECT source_id, kind, {_ELEMENT.format("x")} AS t, {_CARDINALITY.format("x")} AS cardinality, imports, package_name, fqn FROM (
    SELECT class_id AS source_id, 'INJECTS' AS kind, type AS x, imports, package_name, fully_qualified_name AS fqn FROM ent WHERE kind = 'FIELD'
    UNION ALL SELECT class_id, 'INJECTS', unnest({_PARAMETERS}), imports, package_name, fully_qualified_name FROM ent WHERE kind = 'CONSTRUCTOR'
    UNION ALL SELECT class_id, 'RETURNS', type, imports, package_name, fully_qualified_name FROM ent WHERE kind = 'METHOD'
    UNION ALL SELECT class_id, 'ACCEPTS', unnest({_PARAMETERS}), imports, package_name, fully_qualified_name FROM ent WHERE kind = 'METHOD'
    UNION ALL SELECT class_id, 'THROWS', unnest(regexp_extract_all(regexp_extract(text, '\\bthrows ([\\w., ]+)', 1), '([\\w.]+)', 1)), imports, package_name, fully_qualified_name FROM ent WHERE kind IN ('METHOD', 'CONSTRUCTOR')
    UNION ALL SELECT id, 'EXTENDS', unnest({_SUPER.format("extends")}), imports, package_name, fully_qualified_name FROM code UNION ALL SELECT id, 'IMPLEMENTS', unnest({_SUPER.format("implements")}), imports, package_name, fully_qualified_name FROM code) a) b
  WHERE t NOT IN {_in((*PRIMITIVES, ""))}) c WHERE target <> coalesce(fqn, '')""")  # fmt: skip
def rich_dependency_edges(spark, d):
    return o.rich_dependencies(_classes(spark, d))


@query("""SELECT id AS chunk_id, NULL AS parent_id, 'CLASS' AS chunk_type, name FROM (SELECT DISTINCT id, name FROM src) s
 UNION ALL SELECT concat_ws('.', class_id, CASE WHEN kind = 'FIELD' THEN name || '_field' ELSE name END, CAST(place AS VARCHAR)), class_id, kind, name FROM ent WHERE kind IN ('METHOD', 'FIELD', 'CONSTRUCTOR')""")  # fmt: skip
def code_chunks(spark, d):
    return o.chunks(_classes(spark, d))


@query(f"SELECT id, unnest({_CALLED}) AS called FROM code")
def called_methods(spark, d):
    c = table(spark, d, "classes", "id", "source_code").filter("source_code <> ''")
    return c.select("id", F.explode(j.called_methods(j.plain_code(F.col("source_code")))).alias("called")).distinct()


_MEMBERS = "SELECT r.source_id AS class_id, s.name AS class_name, r.target AS member FROM rel r JOIN (SELECT DISTINCT id, name FROM src) s ON s.id = r.source_id WHERE r.kind = '{}'"


@query(_MEMBERS.format("HAS_METHOD"))
def methods_in_class(spark, d):
    return o.members_of(o.relationships(_classes(spark, d)), _nodes(spark, d), "HAS_METHOD")


@query(_MEMBERS.format("HAS_FIELD"))
def fields_in_class(spark, d):
    return o.members_of(o.relationships(_classes(spark, d)), _nodes(spark, d), "HAS_FIELD")


@query(f"""SELECT DISTINCT c.class_name || '.' || c.member AS callee, m.id AS caller_id FROM ({_MEMBERS.format("HAS_METHOD")}) c JOIN (SELECT source_id AS id, target FROM rel WHERE kind = 'CALLS'
  UNION SELECT id, 'METHOD:' || split_part(unnest({_CALLED}), '.', -1) FROM (SELECT id, regexp_replace(regexp_replace(source_code, {_text(j.SKIPPED)}, ' ', 'g'), {_text(j.ANNOTATION)}, ' ', 'g') AS code FROM methods WHERE source_code <> '') x) m ON m.target = 'METHOD:' || c.member""")  # fmt: skip
def method_callers(spark, d):
    """Callers are classes and single stored methods."""
    r = checkpointed(o.relationships(_classes(spark, d)))
    m = table(spark, d, "methods", "id", "source_code").filter("source_code <> ''")
    named = F.transform(j.called_methods(j.plain_code(F.col("source_code"))), lambda c: F.concat(F.lit("METHOD:"), F.substring_index(c, ".", -1)))
    calls = r.filter("kind = 'CALLS'").select("source_id", "target").unionByName(m.select(F.col("id").alias("source_id"), F.explode(named).alias("target")))
    return o.callers(calls, o.members_of(r, _nodes(spark, d), "HAS_METHOD"))


@query("SELECT DISTINCT r.target AS super_type, s.id AS sub_id, s.name AS sub_name FROM rel r JOIN src s ON s.id = r.source_id WHERE r.kind = 'EXTENDS'")
def subclasses(spark, d):
    return o.members_of(o.relationships(_classes(spark, d)), _nodes(spark, d), "EXTENDS").select(F.col("member").alias("super_type"), F.col("class_id").alias("sub_id"), F.col("class_name").alias("sub_name")).distinct()


_TWO = "one AS (SELECT DISTINCT source_id, target FROM rel WHERE kind IN ('EXTENDS', 'IMPLEMENTS', 'TYPE_DEPENDENCY'))"


@query(f", {_TWO} SELECT source_id, target FROM one UNION SELECT a.source_id, b.target FROM one a JOIN src s ON s.name = a.target JOIN one b ON b.source_id = s.id")
def class_dependencies_2hop(spark, d):
    return o.two_hops(checkpointed(o.relationships(_classes(spark, d))), _nodes(spark, d), ("EXTENDS", "IMPLEMENTS", "TYPE_DEPENDENCY"))


@query("""SELECT file, count(*) AS types, CAST(coalesce(sum(deps), 0) AS BIGINT) AS dependencies, CAST(coalesce(sum(subs), 0) AS BIGINT) AS subclasses, round(count(CASE WHEN coalesce(deps, 0) > 0 OR coalesce(subs, 0) > 0 THEN 1 END) / count(*), 4) AS confidence
 FROM (SELECT DISTINCT id, name, file FROM src) s LEFT JOIN (SELECT source_id, count(DISTINCT target) AS deps FROM rel WHERE kind IN ('TYPE_DEPENDENCY', 'EXTENDS', 'IMPLEMENTS') GROUP BY source_id) a ON a.source_id = s.id
 LEFT JOIN (SELECT target, count(DISTINCT source_id) AS subs FROM rel WHERE kind = 'EXTENDS' GROUP BY target) b ON b.target = s.name GROUP BY file""")  # fmt: skip
def context_files(spark, d):
    return o.context_files(_nodes(spark, d), checkpointed(o.relationships(_classes(spark, d))))


@query(r"""SELECT DISTINCT id, CASE WHEN n <> '' AND p <> '' THEN p || '.' || n ELSE n END AS name FROM (SELECT id, regexp_extract(source_code, 'public\s+(?:(?:abstract|final|static|sealed)\s+)*(?:class|interface|enum)\s+(\w+)', 1) AS n,
 regexp_extract(source_code, '(?m)^[ \t]*package\s+([\w.]+)\s*;', 1) AS p FROM code) c""")  # fmt: skip
def class_name_from_code(spark, d):
    c = table(spark, d, "classes", "id", "source_code").filter("source_code <> ''")
    return c.select("id", j.class_name_from_code(F.col("source_code")).alias("name")).distinct()


@query("""SELECT DISTINCT id, x AS type, CASE WHEN contains(x, '.') THEN x WHEN x IN ('boolean', 'byte', 'char', 'short', 'int', 'long', 'float', 'double') THEN 'java.lang.' || x ELSE concat_ws('.', nullif(p, ''), x) END AS resolved
 FROM (SELECT id, return_type AS x, regexp_extract(coalesce(class_name, ''), '^(.*)\\.[^.]*$', 1) AS p FROM methods WHERE return_type <> '') m""".replace("\\\\", "\\"))  # fmt: skip
def resolve_type(spark, d):
    m = table(spark, d, "methods", "id", F.col("return_type").alias("type"), F.regexp_extract(F.coalesce("class_name", F.lit("")), r"^(.*)\.[^.]*$", 1).alias("p")).filter("type <> ''")
    return m.select("id", "type", j.resolve_type(F.col("type"), F.col("p")).alias("resolved")).distinct()


@query(f"SELECT DISTINCT id, t AS type, {_RESOLVE} AS resolved FROM (SELECT e.class_id AS id, {_ELEMENT.format('e.type')} AS t, imports, package_name FROM ent e WHERE kind = 'FIELD') x")
def resolve_fqn(spark, d):
    c = _classes(spark, d)
    fields = o.entities(c).filter("kind = 'FIELD'").select(F.col("class_id").alias("id"), j.element_type(F.col("type"))["type"].alias("type"))
    known = c.filter("source_code <> ''").select("id", "package_name", j.imports(F.col("source_code")).alias("imports")).dropDuplicates(["id"])
    return fields.join(known, "id").select("id", "type", j.resolve_fqn(F.col("type"), F.col("imports"), F.col("package_name")).alias("resolved")).distinct()


@query(r"""SELECT DISTINCT id, CASE WHEN len(p) >= 2 THEN array_to_string(CASE WHEN regexp_matches(p[-1], '^[a-z]') OR p[-1] LIKE '%\_field' ESCAPE '\' THEN p[1:len(p) - 1] ELSE p END, '.') END AS class_name
 FROM (SELECT id, string_split(regexp_replace(id, '^[^:]*:', ''), '.') AS p FROM methods) m""")  # fmt: skip
def class_from_chunk_id(spark, d):
    return table(spark, d, "methods", "id").select("id", j.class_from_chunk_id(F.col("id")).alias("class_name")).distinct()


@query("SELECT DISTINCT id FROM code WHERE len(list_filter(imports, lambda i: i = 'net.brindle' OR i LIKE 'net.brindle.%')) > 0")
def has_library(spark, d):
    c = table(spark, d, "classes", "id", "source_code").filter("source_code <> ''")
    return c.filter(o.has_library(j.imports(F.col("source_code")), "net.brindle")).select("id").distinct()


_BASE = r"^(\w+\.\w+\.\w+)"


@query(f"""SELECT id, list_sort(list(DISTINCT base)) AS libraries FROM (SELECT c.id, p.base FROM (SELECT DISTINCT id, unnest(imports) AS name FROM code) c JOIN (SELECT DISTINCT regexp_extract(package_name, '{_BASE}', 1) AS base FROM src) p ON c.name = p.base OR c.name LIKE p.base || '.%') x GROUP BY id""")
def detect_libraries(spark, d):
    """The library bases (three segments of a known package) that a source's imports begin with, as a set."""
    c = table(spark, d, "classes", "id", "source_code", F.regexp_extract("package_name", _BASE, 1).alias("base"))
    rows = c.filter("source_code <> ''").select("id", F.explode(j.imports(F.col("source_code"))).alias("import_name")).distinct()
    found = prefix_join(rows, "import_name", c, "base").filter("base is not null")
    return found.groupBy("id").agg(F.sort_array(F.collect_set("base")).alias("libraries"))


_PAIR = "asked AS (SELECT id AS start, lead(id) OVER (PARTITION BY repo ORDER BY id) AS \"end\" FROM (SELECT DISTINCT id, regexp_extract(package_name, '^(\\w+\\.\\w+)', 1) AS repo FROM src) s), e AS (SELECT r.source_id AS a, t.id AS b FROM rel r JOIN (SELECT DISTINCT id, name FROM src) t ON t.name = r.target WHERE r.kind IN ('TYPE_DEPENDENCY', 'EXTENDS', 'IMPLEMENTS')), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(start, node, depth) AS (SELECT start, start, 0 FROM asked UNION SELECT c.start, u.b, c.depth + 1 FROM c JOIN u ON u.a = c.node WHERE c.depth < 5)"


@query(f", {_PAIR} SELECT k.start, k.\"end\", min(c.depth) AS hops, CASE WHEN min(c.depth) IS NULL THEN 'No direct relationship found between these entities' ELSE 'Connected via 1 path(s)' END AS explanation FROM asked k LEFT JOIN c ON c.start = k.start AND c.node = k.\"end\" WHERE k.\"end\" IS NOT NULL GROUP BY k.start, k.\"end\"")
def relationship_explanation(spark, d):
    """Asked of every class and the next one of its repository (the first two segments of its package)."""
    c = _classes(spark, d)
    repo = F.regexp_extract("package_name", r"^(\w+\.\w+)", 1).alias("repo")
    asked = c.select("id", repo).distinct().select(F.col("id").alias("start"), F.lead("id").over(Window.partitionBy("repo").orderBy("id")).alias("end")).filter("end is not null")
    named = _nodes(spark, d).select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    edges = o.relationships(c).filter(F.col("kind").isin("TYPE_DEPENDENCY", "EXTENDS", "IMPLEMENTS")).join(named, "target").select("source_id", "target_id", "kind", F.lit("java").alias("repo"))
    return g.relationships(checkpointed(edges), checkpointed(asked))


@query("""SELECT id AS node_id, 'CLASS' AS node_type, name AS simple_name, package_name, NULL AS parent_node_id FROM (SELECT DISTINCT id, name, package_name FROM src) s
 UNION ALL SELECT concat_ws('.', class_id, CASE WHEN kind = 'FIELD' THEN name || '_field' ELSE name END, CAST(place AS VARCHAR)), kind, name, package_name, class_id FROM ent WHERE kind IN ('METHOD', 'FIELD', 'CONSTRUCTOR')""")  # fmt: skip
def chunks_to_nodes(spark, d):
    """Chunks as nodes of the graph, with the package of their type."""
    c = _classes(spark, d)
    packages = c.select(F.col("id").alias("_id"), "package_name").distinct()
    rows = o.chunks(c).join(packages, F.coalesce("parent_id", "chunk_id") == F.col("_id"))
    return rows.select(F.col("chunk_id").alias("node_id"), F.col("chunk_type").alias("node_type"), F.col("name").alias("simple_name"), "package_name", F.col("parent_id").alias("parent_node_id"))
