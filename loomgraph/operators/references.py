"""References to records that do not exist.

A reference is matched to the parents' keys without a join on the keys themselves: every key is split,
without loss, into a namespace (its text up to the trailing hexadecimal digits, and their number) and an
integer (those digits). The sorted parent integers of a namespace are compressed into contiguous runs,
and a reference is matched as of its integer to the run that starts last at or before it; it is an orphan
if there is none or if the integer lies beyond the run's end. Runs are cut at multiples of ``2**block_bits``,
so that the match needs nothing but the block of the key itself and no task holds a whole namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs never span more than ``2**BLOCK_BITS`` consecutive keys, which also bounds a run's array of times.
BLOCK_BITS = 8
#: Copies of each suspect key, among which the rows of one key are spread, unless the caller asks for more.
SALTS = 8


def normal_key(key: Column) -> Column:
    """Keys are equal without case and surrounding blanks and tabs; a blank key is no key (null)."""
    cleaned = F.lower(F.btrim(key.cast("string"), F.lit(" \t")))
    return F.when(cleaned != "", cleaned)


def _encoded(df: DataFrame) -> DataFrame:
    """Adds ``ns``, ``num`` and ``block``: together ``ns`` and ``num`` are the key, without loss."""
    digits = F.regexp_extract("key", r"([0-9a-f]{0,15})\z", 1)
    df = df.withColumn("_digits", digits)
    width = F.length("_digits")
    df = df.withColumns(
        {
            "ns": F.concat_ws("/", "ref_table", F.expr("substring(key, 1, length(key) - length(_digits))"), width.cast("string")),
            "num": F.coalesce(F.conv("_digits", 16, 10).cast("bigint"), F.lit(0).cast("bigint")),
        }
    )
    return df.withColumn("block", F.shiftright("num", BLOCK_BITS)).drop("_digits")


def key_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of the parents' integer keys.

    ``parents``: ref_table, key (normal, not null), first_time; one row a key. Result: ns, block, run_start,
    run_end, times (first_time of each key of the run, in order; an array of at most ``2**BLOCK_BITS``).
    """
    in_block = Window.partitionBy("ns", "block").orderBy("num")
    return (
        _encoded(parents)
        .withColumn("_run", F.col("num") - F.row_number().over(in_block))
        .groupBy("ns", "block", "_run")
        .agg(
            F.min("num").alias("run_start"),
            F.max("num").alias("run_end"),
            F.transform(F.array_sort(F.collect_list(F.struct("num", "first_time"))), lambda x: x["first_time"]).alias("times"),
        )
        .drop("_run")
    )


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of referenced keys to runs.

    ``keys``: ref_table, key and any other columns, one row a key. Adds ``found`` (does the parent exist) and
    ``parent_time`` (its first time, null if it has none or doesn't exist).
    """
    own = [c for c in keys.columns]
    left = _encoded(keys).select("ns", "block", "num", F.lit(1).alias("_side"), F.struct(*own).alias("_own"))
    right = runs.select(
        "ns", "block", F.col("run_start").alias("num"), F.lit(0).alias("_side"), F.struct("run_start", "run_end", "times").alias("_run")
    )
    as_of = Window.partitionBy("ns", "block").orderBy("num", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.last("_run", ignorenulls=True).over(as_of)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_at", run).filter("_side = 1")
    inside = F.coalesce(F.col("num") <= F.col("_at.run_end"), F.lit(False))
    offset = (F.col("num") - F.col("_at.run_start")).cast("int")
    return both.select("_own.*", inside.alias("found"), F.when(inside, F.get(F.col("_at.times"), offset)).alias("parent_time"))


def orphan_references(references: DataFrame, parents: DataFrame, deletions: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows whose reference has no record to refer to, or one that came later than the row.

    ``references``: table_name, row_key, ref_table, ref_key, ref_time. ``parents``: ref_table, parent_key,
    parent_time (repeated keys allowed, the earliest time holds). ``deletions``: ref_table, deleted_key.
    Extra columns are ignored. Result, one row for each table_name and row_key: table_name, row_key, kind
    (``deleted``, ``missing`` or ``late``), ref_time (the row's earliest own time).

    Null and blank keys are no references and no records. A null ref_time or a parent without any time is
    never late. A row repeated with other times is late if one of its copies is. Empty inputs give an empty
    result (references) or all references as orphans (parents).

    Scale: rows are reduced to distinct keys before anything is matched; only keys that are orphans, or
    younger than their earliest referring row, are joined back to the rows, and each of these is copied
    ``salts`` times, so that the rows of a hot key are spread over as many tasks.
    """
    rows = references.select(
        "table_name", "row_key", "ref_table", normal_key(F.col("ref_key")).alias("key"), "ref_time"
    ).filter("key is not null")
    first_seen = (
        parents.select("ref_table", normal_key(F.col("parent_key")).alias("key"), "parent_time")
        .filter("key is not null")
        .groupBy("ref_table", "key")
        .agg(F.min("parent_time").alias("first_time"))
    )
    deleted = (
        deletions.select("ref_table", normal_key(F.col("deleted_key")).alias("key"))
        .filter("key is not null")
        .distinct()
        .withColumn("_deleted", F.lit(True))
    )
    keys = rows.groupBy("ref_table", "key").agg(F.min("ref_time").alias("min_time"))
    suspects = (
        match_runs(keys, key_runs(first_seen))
        .filter("not found or parent_time > min_time")
        .join(deleted, ["ref_table", "key"], "left")
        .select(
            "ref_table",
            "key",
            "parent_time",
            F.when(F.col("found"), "late").when(F.col("_deleted"), "deleted").otherwise("missing").alias("kind"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("table_name", "row_key"), F.lit(salts)).cast("int"))
    return (
        salted.join(suspects, ["ref_table", "key", "_salt"])
        .filter("kind <> 'late' or parent_time > ref_time")
        .groupBy("table_name", "row_key")
        .agg(F.min("kind").alias("kind"), F.min("ref_time").alias("ref_time"))
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphans for each table and calendar month of the referring row (null where it has no time)."""
    return (
        orphans.groupBy("table_name", F.date_format("ref_time", "yyyy-MM").alias("month"))
        .agg(
            F.count("*").alias("orphans"),
            *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("deleted", "missing", "late")),
        )
    )
