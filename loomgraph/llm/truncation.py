"""Text values that lost their end.

How it is found, all in Spark SQL expressions:

1. Texts are made comparable: identifiers in camel case become their shape and last part, tokens with digits ``0``.
   Each line is cut into words and signs, and all trigrams are counted: within lines, at ends of lines, and at ends
   of texts; with the kind of the field and the kind of line (prose, indented, list item, table, JSON ...) as context.
2. The final trigram of each text is joined to these counts. A text is cut off if its final trigram is frequent
   inside and almost never terminal. Where a trigram is too rare to tell, its last two words or its last word decide.
3. A last word that is never seen inside, but is the beginning of words seen in its place, is cut within the word.
4. Open structures (code fences, brackets, strings, tables) and marks such as ``[+12 chars]`` show a lost end, too.

Counts cover all rows, the ends of repeated rows and of equal long texts once; the table of counted trigrams grows with the vocabulary, not with the rows, and is never
collected. The final joins run on distinct final trigrams, so that no ending that many texts share makes a hot key.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

#: A context is known if it was seen so often.
MIN_SEEN = 25
#: ... and shows a lost end if it is terminal in at most this share of cases.
MAX_TERMINAL = 0.012
#: A word is known if it stands inside texts so often.
MIN_WORD = 3

#: A word is out of place if it stands there in less than this share of what would be expected there.
RARE = 0.02

#: Endings in a sign are spread over so many tasks.
SALTS = 16
#: Equal texts of up to so many characters in different rows are one message, whole as often as it is given: each row counts.
MESSAGE = 200

_STOPS = (".", "?", "!", "。", "？", "！", "।", "؟")
_PART = "\ue000"  # between an identifier's shape and its last part
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WIDE = rf"[\p{{L}}\p{{M}}\p{{N}}_$\x{{e000}}&&[^{_CJK}]]"
#: words (those in plain letters first, which is faster), single characters of scripts without blanks, and signs
_TOKEN = rf"[A-Za-z0-9_$\x{{e000}}]++{_WIDE}*+|{_WIDE}++|[^\s\p{{M}}]"
#: the last line ends with an ellipsis, or with a bracket; ``_CUT`` are words that such a bracket has if something was cut off
_ELLIPSIS = r"(?:…|\.\.\.|[\[(<{](?:…|\.\.\.)[\])>}])\s*\z"
_LAST_BRACKET = r"[\[(<{]([^\[(<{\])>}]*)[\])>}]\s*\z"
_CUT = r"(?i)\b(?:truncated|clipped|cut|cut off|omitted|snip|snipped|abbreviated|shortened|chars?|characters|bytes|more lines|more tokens)\b"
#: matched strings, character literals and comments of code (what none of them begins with is passed over at once)
_CLOSED = r"""(?=["'/])(?:\"{3}[\s\S]*?\"{3}|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'(?:\\.|[^'\\\n])'|/\*[\s\S]*?\*/|(?<!:)//[^\n]*)"""


def _abstract(text: Column) -> Column:
    # possessive quantifiers throughout: a word that is no identifier is given up at once
    text = F.regexp_replace(text, r"(?=[A-Z])\b[A-Z][a-z0-9_$]++(?:[A-Z][a-z0-9_$]*+)*([A-Z][a-z]*+)\d*+\b", f"Xx{_PART}$1")
    text = F.regexp_replace(text, r"\b[a-z][a-z0-9_$]*+(?:[A-Z][a-z0-9_$]*+)*([A-Z][a-z]*+)\d*+\b(?!\x{e000})", f"xX{_PART}$1")
    return F.regexp_replace(text, r"\b[A-Za-z_$]*+\d[\w$]*+", "0")


def _plain(word: Column) -> Column:
    return F.substring_index(word, _PART, 1)


def _head(line: Column) -> Column:
    first = F.substring(F.ltrim(line), 1, 1)
    indented = F.substring(line, 1, 1).isin(" ", "\t")
    return F.when(first.rlike(r"\p{L}"), F.when(indented, "i").otherwise("w")).otherwise(first)


def _tokens(line: Column) -> Column:
    return F.concat(F.array(F.lit("^"), F.lit("^")), F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")


def trigram_counts(values: DataFrame) -> DataFrame:
    """(kind, head, w1, w2, w3) of all trigrams of ``values`` (kind, text) but those at their ends, with inner and at_line_end counts.

    w3 keeps the last part of an identifier, w1 and w2 only its shape.
    """
    lines = values.select("kind", _lines(_abstract(F.col("text"))).alias("lines"))
    # outer: else a filter for empty arrays is put before, which makes the array a second time
    lines = lines.select("kind", (F.size("lines") - 1).alias("last"), F.posexplode_outer("lines").alias("at", "line")).filter("line is not null")
    words = lines.select("kind", _head(F.col("line")).alias("head"), (F.col("at") == F.col("last")).alias("final"), _tokens(F.col("line")).alias("t"))
    n = F.greatest(F.size("t"), F.lit(2))
    grams = words.select(
        "kind", "head", "final", n.alias("n"),
        F.posexplode_outer(F.arrays_zip(F.slice("t", 1, n - 2).alias("a"), F.slice("t", 2, n - 2).alias("b"), F.slice("t", 3, n - 2).alias("c"))).alias("at", "g"),
    ).filter("g is not null")
    end = F.col("at") == F.col("n") - 3
    return (
        grams.select("kind", "head", _plain(F.col("g.a")).alias("w1"), _plain(F.col("g.b")).alias("w2"), F.col("g.c").alias("w3"), end.alias("end"), "final")
        .filter("not (end and final)")
        .groupBy("kind", "head", "w1", "w2", "w3")
        .agg(F.count_if(~F.col("end")).alias("inner"), F.count_if(F.col("end")).alias("at_line_end"))
    )


def end_counts(ends: DataFrame) -> DataFrame:
    """(kind, head, w1, w2, w3) of the final trigrams of ``ends`` (also: whose, a hash), with at_end counts.

    Each ``whose`` counts once, so that the own share of any value in its ending is exactly 1.
    """
    keys = ["kind", "head", "w1", "w2", "w3"]
    return ends.filter("w1 is not null").select(*keys, "whose").distinct().groupBy(*keys).agg(F.count("*").alias("at_end"))


#: what is left of a text to see whether something is open: brackets, and quotes that no other one closes on the line
_BRACKETS = ("{}", "()", "[]", "«»", "「」", "（）", "『』", "【】")


def open_structure(rows: DataFrame) -> DataFrame:
    """Adds ``open``: does the text end within a code fence, bracket, string, quotation or table row?"""
    signs = re.escape("".join(_BRACKETS) + '"')
    # two steps: each is used many times below and is to be computed once
    rows = rows.withColumn("_signs", F.regexp_replace(F.regexp_replace("text", _CLOSED, ""), f"[^{signs}]+", ""))
    rows = rows.withColumn("_last", F.rtrim(F.substring_index(F.rtrim("text"), "\n", -1)))
    count = lambda c: F.length("_signs") - F.length(F.replace("_signs", F.lit(c), F.lit("")))
    fences = (F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit("")))) / 3
    tests = [count(a) > count(b) for a, b in _BRACKETS]
    tests += [F.contains("_signs", F.lit('"')), fences % 2 == 1, F.ltrim("_last").startswith("|") & ~F.col("_last").endswith("|"), F.col("_last").endswith("\ufffd")]
    some = F.col("_signs") != ""
    return rows.withColumn("open", (some & reduce(lambda a, b: a | b, tests[: len(_BRACKETS) + 1])) | reduce(lambda a, b: a | b, tests[len(_BRACKETS) + 1 :])).drop("_signs", "_last")


def marked(line: Column) -> Column:
    """Does a last line (without blanks at its end) end with a mark that says that more followed?"""
    bracket = F.when(F.right(line, F.lit(1)).isin("]", ")", ">", "}"), F.regexp_extract(line, _LAST_BRACKET, 1).rlike(_CUT))
    return F.right(line, F.lit(5)).rlike(_ELLIPSIS) | F.coalesce(bracket, F.lit(False))  # no ellipsis is longer than five characters


def _verdicts(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, head, w1, w2, w3, rare, within) of the endings which show that something is lost: by a trigram or context that is hardly ever
    terminal, or by a word that is only the beginning of those in its place.

    Words and signs go separate ways: there are few signs, and all endings with one would meet in one task.
    """
    plain = counts.withColumn("p3", _plain(F.col("w3")))

    def level(*keys: str) -> DataFrame:
        return plain.groupBy("kind", *keys).agg(F.sum("inner").alias("i"), F.sum("at_line_end").alias("l"), F.sum("at_end").alias("e"))

    word = F.col("p3").rlike(r"^[\p{L}\p{N}_$]")
    known = ends.withColumn("p3", _plain(F.col("w3")))
    ratio = F.lit(None).cast("double")
    stop = F.col("p3").isin(*_STOPS)
    for keys in (("head", "p3"), ("w2", "p3"), ("head", "w2", "p3"), ("head", "w1", "w2", "p3")):
        own = level(*keys)
        if keys == ("head", "p3"):  # a full stop alone shows nothing; other single signs are spread
            salt = F.pmod(F.xxhash64("w1", "w2"), F.lit(SALTS)).cast("int")
            own = own.filter(~stop).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(word, 0).otherwise(SALTS - 1))))
            known = known.withColumn("_salt", F.when(word, 0).otherwise(salt)).join(own, ["kind", *keys, "_salt"], "left").drop("_salt")
        else:
            known = known.join(own, ["kind", *keys], "left")
        seen = F.col("i") + F.col("l") + F.col("e") - 1
        terminal = F.col("e") - 1 + F.when(word, F.col("l")).otherwise(0)
        known = known.withColumn("_r", F.when(seen >= MIN_SEEN, terminal / seen)).drop("i", "l", "e")
        known = known.withColumn("ratio", F.coalesce("_r", ratio)).drop("_r")
        ratio = F.col("ratio")
    rare = F.coalesce(F.col("ratio") < MAX_TERMINAL, F.lit(False))
    known = checkpointed(known.withColumn("rare", rare).drop("p3", "ratio"))

    # cut within a word: known words (or parts of identifiers) begin with it in its place, and it is hardly ever there itself
    body = F.substring_index("w3", _PART, -1)  # a whole word, or the last part of an identifier
    there = F.sum(F.col("inner") + F.col("at_line_end") + F.col("at_end"))
    words = counts.groupBy("kind", "w3").agg(there.alias("own"))
    in_place = counts.groupBy("kind", "w2", "w3").agg(there.alias("own_here"))
    parts = counts.groupBy("kind", body.alias("body")).agg(F.sum("inner").alias("as_part"))
    longer = counts.groupBy("kind", "w2", body.alias("body")).agg(F.sum("inner").alias("inner")).filter((F.col("inner") >= MIN_WORD) & (F.length("body") > 1))
    starts = (
        longer.select("kind", "w2", "inner", F.explode(F.transform(F.sequence(F.lit(1), F.length("body") - 1), lambda k: F.col("body").substr(F.lit(1), k))).alias("body"))
        .groupBy("kind", "w2", "body").agg(F.sum("inner").alias("starts"))
    )
    any_start = starts.groupBy("kind", "body").agg(F.sum("starts").alias("any_starts"))
    shapes = counts.groupBy("kind", "w2").agg(
        F.sum(F.when(F.col("w3").startswith("Xx" + _PART), F.col("inner"))).alias("upper"),
        F.sum(F.when(F.col("w3").startswith("xX" + _PART), F.col("inner"))).alias("lower"),
    )
    wordly = F.col("w3").rlike(r"^[\p{L}\p{N}_$\x{e000}]")
    words_only = (
        known.filter(wordly).withColumn("body", body)
        .join(words, ["kind", "w3"], "left")
        .join(in_place, ["kind", "w2", "w3"], "left")
        .join(parts, ["kind", "body"], "left")
        .join(starts, ["kind", "w2", "body"], "left")
        .join(any_start, ["kind", "body"], "left")
        .join(shapes, ["kind", "w2"], "left")
    )

    def outweighs(other: str, own: str) -> Column:
        others, own_ = F.coalesce(F.col(other), F.lit(0)), F.coalesce(F.col(own), F.lit(1)) - 1
        return (others >= MIN_WORD) & (own_ < others * RARE)

    identifier = F.contains(F.col("w3"), F.lit(_PART))
    unfit_part = outweighs("any_starts", "own") | (F.col("w3").startswith("Xx") & outweighs("as_part", "own"))
    first_part = F.when(F.col("w3").rlike(r"^[A-Z][a-z]*$"), outweighs("upper", "own_here")).when(F.col("w3").rlike(r"^[a-z]+$"), outweighs("lower", "own_here"))
    within = F.when(identifier, unfit_part).when(F.col("w3").rlike(r"^\p{L}"), outweighs("starts", "own_here") | F.coalesce(first_part, F.lit(False))).otherwise(False)
    told = words_only.withColumn("within", F.coalesce(within, F.lit(False))).unionByName(known.filter(~wordly).withColumn("within", F.lit(False)), allowMissingColumns=True)
    return told.filter("rare or within").select("kind", "head", "w1", "w2", "w3", "rare", "within")


def truncation_verdicts(values: DataFrame) -> DataFrame:
    """table_name, id, field_name, rare, within, shown: the values whose end was lost, once each, and what shows it.

    Every value goes through the verdict on its final trigram (``rare``) and on its last word (``within``); ``shown`` are open
    structures and marks. ``values``: table_name, id, field_name, text; other columns are ignored, rows may be repeated. Null and
    blank texts are no cases. Texts of any length are read whole. Where almost nothing is known (few rows), only open
    structures and marks decide; so too for a value of a single word or sign (``null``, ``-``), which has nothing around it to
    tell by. An empty table gives an empty result.
    """
    rows = values.select("table_name", "id", "field_name", F.col("field_name").alias("kind"), "text").filter(F.btrim("text", F.lit(" \t\r\n")) != "")
    counts = checkpointed(trigram_counts(rows))
    t = F.col("t")
    # copies of a row, and rows with the same long text, are one case; a short message that many rows share is as many
    body = F.rtrim(F.col("text"), F.lit(" \t\r\n"))
    whose = F.when(F.length(body) > MESSAGE, F.xxhash64("field_name", body)).otherwise(F.xxhash64("table_name", "id", "field_name"))
    ends = (
        open_structure(rows)
        .withColumn("shown", F.col("open") | marked(F.substring_index(F.rtrim("text", F.lit(" \t\r\n")), "\n", -1)))
        .withColumn("line", _abstract(F.substring_index(F.rtrim("text", F.lit(" \t\r\n")), "\n", -1)))
        .select("table_name", "id", "field_name", "kind", "shown", whose.alias("whose"), _head(F.col("line")).alias("head"), _tokens(F.col("line")).alias("t"), (~body.rlike(r"\s")).alias("single"))
        .select(
            "table_name", "id", "field_name", "kind", "head", "shown", "whose",
            _plain(F.try_element_at(t, F.lit(-3))).alias("w1"), _plain(F.try_element_at(t, F.lit(-2))).alias("w2"), F.try_element_at(t, F.lit(-1)).alias("w3"), (F.col("single") & (F.size("t") <= 3)).alias("single"),
        )
    )
    ends = checkpointed(ends).filter("shown or w1 is not null")
    keys = ["kind", "head", "w1", "w2", "w3"]
    counts = counts.withColumn("at_end", F.lit(0).cast("bigint")).unionByName(checkpointed(end_counts(ends)), allowMissingColumns=True).fillna(0, ["inner", "at_line_end"])
    lost = _verdicts(ends.filter("w1 is not null and not single").select(keys).distinct(), counts)
    told = ends.join(lost.withColumn("single", F.lit(False)), [*keys, "single"], "left").select("table_name", "id", "field_name", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("rare", "within", "shown")))
    return told.filter("rare or within or shown").groupBy("table_name", "id", "field_name").agg(*(F.bool_or(c).alias(c) for c in ("rare", "within", "shown")))


def truncated_values(values: DataFrame) -> DataFrame:
    """table_name, id and field_name of the values whose end was lost, see ``truncation_verdicts``."""
    return truncation_verdicts(values).select("table_name", "id", "field_name")


FIELDS = (("llm_call_metrics", "error_message"), ("llm_call_metrics", "response"), ("agent_executions", "error_message"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (table(spark, d, t).select(F.lit(t).alias("table_name"), "id", F.lit(c).alias("field_name"), "agent_name", F.col(c).alias("text")) for t, c in FIELDS),
    )


def truncation_rates(values: DataFrame, truncated: DataFrame) -> DataFrame:
    """For each agent and field: number of values (not null, not blank, each row once), of truncated ones, and share."""
    all_ = values.filter(F.btrim("text", F.lit(" \t\r\n")) != "").select("table_name", "id", "field_name", "agent_name").dropDuplicates(["table_name", "id", "field_name"])
    return (
        all_.join(truncated.withColumn("_cut", F.lit(1)), ["table_name", "id", "field_name"], "left")
        .groupBy("agent_name", "table_name", "field_name")
        .agg(F.count("*").alias("n_values"), F.count("_cut").alias("n_truncated"))
        .withColumn("share", F.col("n_truncated") / F.col("n_values"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_values(_values(spark, d))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    values = _values(spark, d)
    return truncation_rates(values, truncated_values(values))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
