"""Percentiles of very large numeric columns from mergeable rank summaries.

A summary describes ``n`` values by a short sorted list of tuples ``(v, g, delta)``, as Greenwald and Khanna
have them: the lowest possible rank of ``v`` is the sum of ``g`` up to it, the highest one is ``delta`` more.
Equal values are told apart by their order, so that a heap of equal values may have several tuples. The smallest
and the largest value are always kept. ``width`` is the largest ``g + delta``: for every rank there is a tuple
within ``width / 2`` ranks of it. Nothing is random: the same values in the same summaries give the same tuples.

* summarise: of the sorted values of a batch every ``floor(2 * eps * n)``-th is kept, with exact rank (delta 0).
* merge: the tuples of several summaries, sorted together; a tuple's ``delta`` grows by what the next larger
  tuple of each other summary leaves open. The new width is at most the sum of the widths, hence no larger a
  share of ``n`` than the largest of the parts had.
* compress: neighbours are united while ``g + delta`` of the united tuple stays within ``2 * eps * n``.

Levels: part of a day -> day -> month -> all. Each level may spend a further share of ``eps`` (``LEVELS``), which is
what leaves compress room to keep the lists short; so an answer is off by at most ``eps * n`` ranks, whatever the
number of summaries. The tracked error, ``width / 2``, is returned too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

#: Permitted error of the end result as a share of all values of a group, in ranks.
EPS = 0.002
#: Share of EPS that is spent after batches, days, months and the whole.
LEVELS = (0.5, 0.7, 0.85, 1.0)
#: At most so many summaries of a group are merged by one call.
FAN_IN = 32
#: A day is summarised in so many parts at least, so that a day which holds a third of all rows is no single task's.
DAY_PARTS = 16
#: Values held by a task before they are summarised.
HELD = 2_000_000
PERCENTILES = (0.5, 0.9, 0.95, 0.99)

_SUMMARY = "n bigint, width bigint, v array<double>, g array<bigint>, delta array<bigint>"
_NAMES = ["n", "width", "v", "g", "delta"]

Summary = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def summarise(values: np.ndarray, groups: np.ndarray, eps: float) -> tuple[np.ndarray, ...]:
    """Summaries of all groups of a batch at once: (n, width, tuples) of each group, then v, g of all tuples.

    ``groups`` are codes from 0 without gaps; ``delta`` is 0 throughout.
    """
    order = np.lexsort((values, groups))
    values, groups = values[order], groups[order]
    n = np.bincount(groups)
    start = np.cumsum(n) - n
    rank = np.arange(1, len(values) + 1) - start[groups]
    step = np.maximum(1, (2 * eps * n).astype(np.int64))
    keep = (rank == 1) | (rank == n[groups]) | (rank % step[groups] == 0)
    rank, groups, values = rank[keep], groups[keep], values[keep]
    g = np.diff(rank, prepend=0)
    g = np.where(rank == 1, 1, g)
    width = np.zeros(len(n), np.int64)
    np.maximum.at(width, groups, g)
    return n, width, np.bincount(groups, minlength=len(n)), values, g


def merge(parts: list[Summary]) -> Summary:
    """The summary of all values of several summaries."""
    v = np.concatenate([p[2] for p in parts])
    g = np.concatenate([p[3] for p in parts])
    delta = np.concatenate([p[4] for p in parts]).copy()
    source = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
    for k, (_, width, pv, pg, pd) in enumerate(parts):
        if width <= 1:
            continue  # it holds every value: nothing is open between its tuples
        open_ = np.append(pg + pd - 1, 0)
        before, after = source < k, source > k
        delta[before] += open_[np.searchsorted(pv, v[before], side="left")]
        delta[after] += open_[np.searchsorted(pv, v[after], side="right")]
    order = np.lexsort((source, v))
    v, g, delta = v[order], g[order], delta[order]
    return sum(p[0] for p in parts), int(np.max(g + delta, initial=0)), v, g, delta


def compress(summary: Summary, eps: float) -> Summary:
    """Fewer tuples: neighbours are united, from the largest value down, while the permitted width allows it."""
    n, _, v, g, delta = summary
    allowed = int(2 * eps * n)
    if allowed < 2 or len(v) < 3:
        return summary
    united, keep = g.tolist(), [len(v) - 1]
    open_ = (g + delta).tolist()
    for i in range(len(v) - 2, 0, -1):
        k = keep[-1]
        if united[i] + open_[k] <= allowed:
            united[k] += united[i]
            open_[k] += united[i]
        else:
            keep.append(i)
    keep = np.array([*keep, 0][::-1])
    g = np.array(united, np.int64)[keep]
    return n, int(np.max(g + delta[keep])), v[keep], g, delta[keep]


def quantile(summary: Summary, p: float) -> float | None:
    """A value whose rank is within ``width / 2`` of ``ceil(p * n)``."""
    n, _, v, g, delta = summary
    if not n:
        return None
    target = min(n, max(1, int(np.ceil(p * n - 1e-9))))
    low = np.cumsum(g)
    return float(v[np.argmin(np.maximum(target - low, low + delta - target))])


def _codes(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A code for each row by its keys, from 0 without gaps, and the first row of each code; null is a key."""
    codes = np.zeros(len(t), np.int64)
    for k in keys:
        d = t[k].combine_chunks()
        d = (d.chunk(0) if isinstance(d, pa.ChunkedArray) else d).dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _table(keys: pa.Table, n: np.ndarray, width: np.ndarray, sizes: np.ndarray, v: np.ndarray, g: np.ndarray, delta: np.ndarray) -> pa.Table:
    columns = [pa.array(n, pa.int64()), pa.array(width, pa.int64()), _lists(sizes, v, pa.float64()), _lists(sizes, g, pa.int64()), _lists(sizes, delta, pa.int64())]
    for name, column in zip(_NAMES, columns):
        keys = keys.append_column(name, column)
    return keys


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + _SUMMARY


def batch_summaries(df: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """Summaries of each group in each partition of ``df``, without a shuffle; null values are left out.

    Result: the keys and the summary, of some groups several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            codes, first = _codes(t, keys)
            n, width, sizes, v, g = summarise(t[value].to_numpy(), codes, eps)
            yield from _table(t.select(keys).take(pa.array(first)), n, width, sizes, v, g, np.zeros(len(g), np.int64)).to_batches(10_000)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > HELD:
                yield from done()
                held, size = [], 0
        if size:
            yield from done()

    values = df.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    return values.mapInArrow(run, _schema(df, keys))


def _summaries(t: pa.Table) -> list[Summary]:
    columns = []
    for name in ("v", "g", "delta"):
        c = t[name].combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        offsets = c.offsets.to_numpy()
        columns.append(np.split(c.values.to_numpy()[offsets[0] : offsets[-1]], offsets[1:-1] - offsets[0]))
    return list(zip(t["n"].to_pylist(), t["width"].to_pylist(), *columns))


def merge_all(parts: list[Summary], spent: float, eps: float) -> Summary:
    """All parts, whose error is at most ``spent``, merged in rounds of ``FAN_IN`` and compressed up to ``eps``."""
    rounds, n = 1, len(parts)
    while n > FAN_IN:
        rounds, n = rounds + 1, -(-n // FAN_IN)
    for r in range(1, rounds + 1):
        now = spent + (eps - spent) * r / rounds
        parts = [compress(merge(parts[i : i + FAN_IN]), now) if len(parts) > 1 else parts[0] for i in range(0, len(parts), FAN_IN)]
    return parts[0]


def merge_summaries(df: DataFrame, together: list[Column], keys: list[str], spent: float, eps: float) -> DataFrame:
    """The summaries with the same keys merged into one and compressed: the keys and the summary.

    ``together`` says which rows come into one task at once; it has to follow from the keys. It keeps the calls of
    Python few where groups are small, and each small enough where they are not.
    """

    def run(t: pa.Table) -> pa.Table:
        codes, first = _codes(t, keys)
        parts: list[list[Summary]] = [[] for _ in first]
        for code, summary in zip(codes, _summaries(t)):
            parts[code].append(summary)
        merged = [merge_all(own, spent, eps) for own in parts]
        n, width, v, g, delta = zip(*merged)
        sizes = np.array([len(x) for x in v])
        return _table(t.select(keys).take(pa.array(first)), np.array(n), np.array(width), sizes, *map(np.concatenate, (v, g, delta)))

    columns = {f"_together{i}": c for i, c in enumerate(together)}
    return df.withColumns(columns).groupBy(*columns).applyInArrow(run, _schema(df, keys))


def daily_summaries(values: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """One summary for each group and day: what is to be stored, and combined over any days.

    ``values``: the keys, day, value.
    """
    parts = batch_summaries(values, [*keys, "day"], "value", eps * LEVELS[0])
    return merge_summaries(parts, [F.col("day"), F.pmod(F.hash(*keys), F.lit(4))], [*keys, "day"], eps * LEVELS[0], eps * LEVELS[1])


def read_percentiles(summaries: DataFrame, keys: list[str], eps: float, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """The keys, p, value, n, tuples, rank_error (tracked) and rank_bound (``floor(eps * n)``) of each summary and p.

    ``value`` has a rank within ``rank_error`` of ``ceil(p * n)``, and ``rank_error <= rank_bound``. ``tuples`` is the
    length of the summary, against ``n`` values.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, p, quantile(s, p), s[0], len(s[2]), s[1] // 2) for i, s in enumerate(_summaries(pa.Table.from_batches([batch]))) for p in ps]
            at, *rest = zip(*out) if out else [[]] * 6
            columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            columns += [pa.array(c, kind) for c, kind in zip(rest, (pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "p", "value", "n", "tuples", "rank_error"])

    schema = _schema(summaries, keys).removesuffix(_SUMMARY)
    out = summaries.mapInArrow(read, f"{schema}p double, value double, n bigint, tuples int, rank_error bigint")
    return out.withColumn("rank_bound", F.floor(F.col("n") * eps).cast("bigint"))


def monthly_summaries(daily: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """Daily summaries merged by month."""
    months = daily.withColumn("month", F.trunc("day", "month"))
    return merge_summaries(months, [F.col("month"), F.pmod(F.hash(*keys), F.lit(8))], [*keys, "month"], eps * LEVELS[1], eps * LEVELS[2])


def whole_summaries(monthly: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """Monthly summaries merged over all time."""
    return merge_summaries(monthly, [F.pmod(F.hash(*keys), F.lit(64))], keys, eps * LEVELS[2], eps)


def percentiles(daily: DataFrame, keys: list[str], eps: float = EPS, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Percentiles of each group over all of its days, see ``read_percentiles``. Days are merged into months first, then months."""
    return read_percentiles(whole_summaries(monthly_summaries(daily, keys, eps), keys, eps), keys, eps, ps)


def call_measures(calls: DataFrame, day_parts: int | None = None) -> DataFrame:
    """One row for each call and measure: agent_name, model, day, measure, value.

    A call that is there several times counts once (all its copies have the same call_ts, which may be null; so one
    shuffle, by parts of days, serves both this and the summaries). Null and -1 (not measured) are left out, 0
    counts. Null agents and models are groups of their own. ``day_parts``: a quarter of the shuffle partitions unless
    given, so that a day with a third of all rows is spread over a quarter of the tasks.
    """
    if day_parts is None:
        day_parts = max(DAY_PARTS, int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = calls.select(
        "id", "agent_name", "model", "latency_ms", "total_tokens",
        F.to_date("call_ts").alias("day"), F.pmod(F.xxhash64("id"), F.lit(day_parts)).alias("_part"),
    )
    once = rows.repartition("day", "_part").dropDuplicates(["day", "_part", "id"])
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("latency_ms", "total_tokens")))
    return once.select("agent_name", "model", "day", F.inline(measures)).filter("value is not null and value <> -1")


KEYS = ["agent_name", "model", "measure"]


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_summaries(call_measures(table(spark, d, "llm_call_metrics")), KEYS)


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of every day, month and of all time (``period``: day, month or all; ``since``: its first day), by agent, model and measure.

    Each level is merged from the summaries of the one below, which are written once.
    """
    daily = checkpointed(_daily(spark, d))
    monthly = checkpointed(monthly_summaries(daily, KEYS))
    levels = (("day", daily.withColumnRenamed("day", "since")), ("month", monthly.withColumnRenamed("month", "since")), ("all", whole_summaries(monthly, KEYS).withColumn("since", F.lit(None).cast("date"))))
    rows = (read_percentiles(s, [*KEYS, "since"], EPS).withColumn("period", F.lit(name)) for name, s in levels)
    return reduce(DataFrame.unionByName, rows)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_daily(spark, d), KEYS)


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of single days, from the summaries that ``p4_percentiles`` combines."""
    return read_percentiles(_daily(spark, d), [*KEYS, "day"], EPS)


QUERIES = {"p4_levels": p4_levels, "p4_percentiles": p4_percentiles, "p4_daily": p4_daily}
SQL: dict[str, str] = {}
