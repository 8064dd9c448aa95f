"""Search results: union, deduplication, ranking and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.java import SKIPPED


def first_then_rank(results: list[DataFrame], k: int) -> DataFrame:
    """id, score and strategy of the best ``k``: an id that several strategies found counts with the first of them.

    ``results``: id, score, in the order of the strategies; ties go by id. Ids are united by a partial aggregate, and the
    top ``k`` are taken in every task before they meet.
    """
    named = [df.select("id", "score", F.lit(i).alias("strategy")) for i, df in enumerate(results)]
    first = reduce(DataFrame.unionByName, named).groupBy("id").agg(F.min_by(F.struct("score", "strategy"), F.struct("strategy", -F.col("score"))).alias("f"))
    return first.select("id", "f.*").orderBy(F.desc("score"), "id").limit(k)


# 0.5, 0.7, 0.8, 0.15 and the third to eleventh score.
def adaptive_threshold(scores: Column) -> Column:
    """The score from which hits are kept, from an array in descending order.

    Up to three scores: 0.7 of the top one, 0.5 at least. More: the score before the largest gap after the third to
    eleventh score if that gap is 0.15 or more, else 0.7 of the top one; within 0.5 and 0.8. None: 0.5.
    """
    top = F.get(scores, F.lit(0)) * 0.7
    places = F.sequence(F.lit(2), F.least(F.size(scores) - 2, F.lit(9)))
    gaps = F.transform(places, lambda i: F.struct((F.get(scores, i) - F.get(scores, i + 1)).alias("gap"), (-i).alias("at")))
    best = F.array_max(gaps)
    many = F.least(F.lit(0.8), F.greatest(F.lit(0.5), F.when(best["gap"] >= 0.15, F.get(scores, -best["at"])).otherwise(top)))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) == 0, 0.5).when(F.size(scores) <= 3, F.greatest(F.lit(0.5), top)).otherwise(many)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one with the largest ``order``, of equal ones the new."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    values = [c for c in existing.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col(order), F.col("_new"))).alias("v")).select(*keys, "v.*")


def prefix_join(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """``names`` with the longest dotted prefix (whole segments) that is in ``prefixes``; an equi-join on all prefixes of a name.

    Names without any come with null. Names are reduced to distinct ones before they are taken apart.
    """
    distinct = names.select(F.col(name).alias("_name")).distinct()
    parts = F.split("_name", r"\.")
    heads = distinct.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("head")))).alias("h"))
    found = heads.join(prefixes.select(F.col(prefix).alias("_prefix")).distinct(), F.col("h.head") == F.col("_prefix")).groupBy("_name").agg(F.max_by("_prefix", "h.n").alias(prefix))
    return names.join(found, names[name] == found["_name"], "left").drop("_name")


def test_summary(logs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, run, failed, skipped, passed and failed_tests of each log with a line 'Tests run:': run and skipped of the last such line,
    failures and errors of all of them, passed = run - failed, and the names before ``<<< FAILURE!`` or ``<<< ERROR!``.
    """
    some = logs.filter(F.contains(text, F.lit("Tests run:")))
    lines = some.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "line")).filter(F.contains("line", F.lit("Tests run:")) | F.contains("line", F.lit("<<< ")))
    number = lambda name: F.nullif(F.regexp_extract("line", name + ": *([0-9]{1,9})", 1), F.lit("")).cast("int")
    zero = lambda name: F.coalesce(number(name), F.lit(0))
    name = F.nullif(F.regexp_extract("line", r"([\w.$]+)[^<]*<<< (?:FAILURE|ERROR)!", 1), F.lit(""))
    rows = lines.select(key, "_at", number("Tests run").alias("run"), (zero("Failures") + zero("Errors")).alias("bad"), zero("Skipped").alias("skip"), name.alias("name"))
    told = F.col("run").isNotNull()
    out = rows.groupBy(key).agg(
        F.max_by("run", F.when(told, F.col("_at"))).alias("run"), F.sum(F.when(told, F.col("bad"))).alias("failed"), F.max_by("skip", F.when(told, F.col("_at"))).alias("skipped"),
        F.sort_array(F.collect_set("name")).alias("failed_tests"),
    )
    return out.filter("run is not null").withColumn("passed", F.col("run") - F.col("failed"))


def code_quality(methods: DataFrame, most: int) -> DataFrame:
    """id, lines (from the first brace to the last one), null_returns and else_ifs of methods with more than ``most`` lines, a ``return null``, or
    a chain of conditions. Strings and comments don't count, so braces in them don't either."""
    code = methods.filter("source_code <> ''").select("id", F.regexp_replace("source_code", SKIPPED, " ").alias("code"))
    body = F.regexp_extract("code", r"(?s)(\{.*\})", 1)
    out = code.select("id", F.size(F.split(body, "\n")).alias("lines"), F.regexp_count("code", F.lit(r"\breturn\s+null\s*;")).alias("null_returns"), F.regexp_count("code", F.lit(r"\belse\s+if\s*\(")).alias("else_ifs"))
    return out.filter((F.col("lines") > most) | (F.col("null_returns") > 0) | (F.col("else_ifs") > 0)).distinct()
