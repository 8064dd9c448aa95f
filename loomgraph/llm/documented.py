"""Functions paired with their documentation.

Each source text is lexed by ``java_members`` (strings, characters, text blocks and comments are told apart, braces
delimit the bodies); the last doc comment before a declaration, with only blank lines, annotations and line comments
between, is its documentation. For single stored methods without any doc comment, the ``javadoc`` column is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.java_members import members
from loomgraph.sources.tables import table

# Words of the vocabularies below say nothing about what a member does.
#: the kind of member, and words that only join it to its name
_KIND = set(
    "a an the this that these its it and or of for to with from by in on as is are method methods function functions constructor constructors "
    "ctor getter setter accessor mutator procedure routine operation member implementation implements creates create creating constructs construct "
    "instantiates instantiate initializes initialises new default empty public private protected static instance object class interface enum record "
    "parameter parameters param params argument arguments arg args return returns returned result get gets set sets does performs perform executes "
    "given specified name named called used uses using without any no takes konstruktor constructeur construtor methode méthode método función funktion fonction função конструктор метод".split()
)
#: placeholders, templates and to-do notes: at least one word of the second set, and none outside of both
_FILLER = set("a an the this that of for to be here in is it no not yet none and or by with add insert put write enter fill give your some please later soon needed "
              "need needs method function class constructor member text goes comes auto automatically was has have file use change settings templates method's "
              "replace its what does do code parameter parameters are which goes".split())  # fmt: skip
_PLACEHOLDER = set("todo fixme tbd xxx tba na nothing comment comments description descriptions describe documentation document documented documents doc docs javadoc javadocs "
                   "nonjavadoc missing generated template stub placeholder undocumented pending lorem ipsum dummy".split())  # fmt: skip
#: pointers to documentation elsewhere
_POINTER = set("see also refer refers same as in described documented inherited inherits inherit from overrides overridden cf copied defined specified the of for to at on and or super superclass "
               "supertype parent base interface class method methods documentation docs doc javadoc description comment contract specification spec details detail more information info "
               "declaration declared a an all full complete further there elsewhere above below page wiki handbook section link links please its it is this that by overriding implemented here".split())  # fmt: skip
_POINTING = set("see refer refers same described documented inherited inherits inherit overrides overridden cf copied defined specified".split())

_TODO_WORD = re.compile(r"\W*(?:TODO|FIXME|XXX|TBD)\b|\W*(?:todo|fixme|xxx|tbd|to-do)\s*(?:[:(\[\-]|\W*$)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_TAG = re.compile(r"@[A-Za-z]")


def description(comment: str) -> str:
    """The text of a doc comment, or of a javadoc column with or without comment signs, before its first block tag."""
    text = comment.strip()
    if text.startswith("/**"):
        text = text[3:]
    if text.endswith("*/"):
        text = text[:-2]
    lines = []
    for line in re.split(r"\r\n|\r|\n", text):
        line = re.sub(r"^\s*\*+(?!/)", "", line).strip()
        if _TAG.match(line):
            break
        lines.append(line)
    return "\n".join(lines).strip()


def _parts(name: str) -> set[str]:
    return {p.lower() for p in _PART.findall(name)} | {re.sub(r"\d+$", "", name).lower(), name.lower()}


def _says(word: str, own: set[str]) -> bool:
    """Is the word, perhaps inflected, one of the name's own words?"""
    if word in own:
        return True
    stems = [word[: -len(e)] for e in ("s", "es", "ed", "d", "ing", "er", "or") if word.endswith(e) and len(word) > len(e) + 1]
    stems += [s + "e" for s in stems] + [s[:-1] for s in stems if len(s) > 2 and s[-1] == s[-2]]
    if word.endswith(("ies", "ied")):
        stems.append(word[:-3] + "y")
    return any(s in own for s in stems)


def trivial(text: str, name: str, params: tuple[str, ...], owner: str) -> bool:
    """Does a description say nothing? See TESTDATA: blank, markup, placeholder, pointer, or only its own names."""
    plain = html.unescape(re.sub(r"<!--[\s\S]*?-->|</?[A-Za-z][^<>]*>", " ", text))
    inherits = "{@inheritdoc}" in plain.lower()
    plain = re.sub(r"\{@inheritdoc\}", " ", plain, flags=re.IGNORECASE)
    links = re.findall(r"\{@(?:link|linkplain|value|see)\s[^{}]*\}|https?://\S+", plain)
    rest = re.sub(r"\{@(?:link|linkplain|value|see)\s[^{}]*\}|https?://\S+", " ", plain)
    rest = re.sub(r"\{@\w+\s*([^{}]*)\}", r" \1 ", rest)
    words = _WORD.findall(rest)
    if not words and not links:
        return True
    if _TODO_WORD.match(plain):
        return True
    low = [w.lower() for w in words]
    if any(w in _PLACEHOLDER for w in low) and all(w in _PLACEHOLDER or w in _FILLER for w in low) and not links:
        return True
    if re.fullmatch(r"\W*n\W?a\W*|\W*non\W?javadoc\W*", plain.strip(), re.IGNORECASE):
        return True
    # a name in code form (camel case, or with a dot, hash or call behind it) is what a pointer points to
    coded = set(re.findall(r"[\w$]*[a-z][A-Z][\w$]*|[\w$]+(?=[#.]\w)|(?<=[#.])[\w$]+|[\w$]+(?=\()", rest))
    if (inherits or links or low[:1] and low[0] in _POINTING or low[:2] == ["please", "see"]) and all(w.lower() in _POINTER or w in coded for w in words):
        return True
    own = _parts(name) | _parts(owner)
    for p in params:
        own |= _parts(p)
    linked = [w for x in links for w in _WORD.findall(re.sub(r"^\{@\w+", "", x))]
    says = lambda w: w.lower() in _KIND or _says(w.lower(), own) or all(_says(p.lower(), own) or p.lower() in _KIND for p in _PART.findall(w)) and bool(_PART.findall(w))
    return all(says(w) for w in [*words, *linked])


_SCHEMA = "table_name string, id string, place bigint, method_name string, start_line int, code string, description string"


def documented_functions(sources: DataFrame) -> DataFrame:
    """Pairs of code and description of every method or constructor with a body and documentation that says something.

    ``sources``: table_name, id, source_code, javadoc, owner (class name, used where the source has no type), and
    single (true: the source is one member, whose documentation may stand in javadoc). Other columns are ignored.
    Result: table_name, id, method_name, start_line (of the name, from 1), code, description; one row for each member.

    Null and empty sources give nothing; a source that ends within a body gives that member with what is there. Rows
    with the same table_name and id are one. Very long sources are lexed whole, in linear time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, i, source, javadoc, owner, single in zip(*(c.to_pylist() for c in batch.columns)):
                if not source:
                    continue
                found, any_doc = members(source, bool(single))
                for m in found:
                    comment = m.doc if m.doc is not None else javadoc if single and not any_doc else None
                    if not comment:
                        continue
                    text = description(comment)
                    if not trivial(text, m.name, m.params, m.owner or (owner or "").rpartition(".")[2]):
                        out.append((t, i, m.start, m.name, m.line, source[m.start : m.end], text))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["table_name", "id", "place", "method_name", "start_line", "code", "description"])

    found = sources.select("table_name", "id", "source_code", "javadoc", "owner", "single").mapInArrow(run, _SCHEMA)
    # repeated rows are alike: what is found in them is made unique, and no source is shuffled
    return found.dropDuplicates(["table_name", "id", "place"]).drop("place")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "classes").select(
        F.lit("classes").alias("table_name"), "id", "source_code", F.lit(None).cast("string").alias("javadoc"), F.lit(None).cast("string").alias("owner"), F.lit(False).alias("single")
    )
    methods = table(spark, d, "methods").select(
        F.lit("methods").alias("table_name"), "id", "source_code", "javadoc", F.col("class_name").alias("owner"), F.lit(True).alias("single")
    )
    return classes.unionByName(methods)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(_sources(spark, d)).select("table_name", "id", "method_name", "start_line")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(_sources(spark, d)).select("table_name", "id", "method_name", "code", "description")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
SQL: dict[str, str] = {}
