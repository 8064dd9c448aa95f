"""Documents packed into containers of a fixed number of tokens.

Bounded-space online packing: each partition keeps ``WINDOWS`` open containers. An item goes into the open container
that it fills best; if it fits none, the fullest one is closed and a new one opened. What is open at the end of a
partition is merged: the leftovers of up to ``FAN_IN`` partitions are packed again as whole items, then the leftovers of
that, until one group is left; so no task ever holds more than ``WINDOWS * FAN_IN`` containers of a budget.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.sizes import tokenizer
from loomgraph.llm.tokenizing import TOKENIZERS
from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

WINDOWS = 32
FAN_IN = 64


class Packer:
    """Best fit into a bounded number of open containers of one capacity."""

    def __init__(self, capacity: int, windows: int = WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room, number), the fullest first
        self.opened = 0

    def put(self, size: int) -> int:
        """The number of the container for an item of ``size <= capacity``."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) == self.windows:
                self.open.pop(0)
            room, number = self.capacity, self.opened
            self.opened += 1
        insort(self.open, (room - size, number))
        return number


def sized_documents(documents: DataFrame, budgets: list[tuple[int, str, int]], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, budget_id, n_tokens) of each document and budget; without documents whose text is null or empty."""
    names = sorted({name for _, name, _ in budgets})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = {name: [tokenizer(folder, name).size(t) for t in texts] for name in names}
            for budget, name, _ in budgets:
                n = pa.array(sizes[name], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([budget] * len(texts), pa.int32()), n], names=["doc_id", "budget_id", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text <> ''")
    return texts.mapInArrow(run, "doc_id bigint, budget_id int, n_tokens bigint").filter("n_tokens > 0")


_PLACED = "budget_id int, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, container string, fill bigint, left_open boolean"


def _place(sized: DataFrame, capacities: dict[int, int], partitions: int) -> DataFrame:
    """Every item with its container, by partition; ``fill`` is that of the container in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = {b: Packer(c) for b, c in capacities.items()}
        fills: dict[tuple[int, int], int] = {}
        waiting: list[tuple] = []

        def rows(done: list[tuple], open_: set) -> pa.RecordBatch:
            columns = zip(*((b, d, p, s, n, f"{part}-{k}", fills[b, k], (b, k) in open_) for b, d, p, s, n, k in done))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["budget_id", "doc_id", "piece_no", "start_token", "n_tokens", "container", "fill", "left_open"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        def now_open() -> set:
            return {(b, k) for b, p in packers.items() for _, k in p.open}

        for batch in batches:
            for doc, budget, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "budget_id", "n_tokens"))):
                capacity, packer = capacities[budget], packers[budget]
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    if size == capacity:  # full at once: it takes no window
                        number, packer.opened = packer.opened, packer.opened + 1
                    else:
                        number = packer.put(size)
                    fills[budget, number] = fills.get((budget, number), 0) + size
                    waiting.append((budget, doc, piece, start, size, number))
            if len(waiting) > 50_000:  # items of closed containers go out, others wait for their container's fill
                open_ = now_open()
                done = [w for w in waiting if (w[0], w[5]) not in open_]
                waiting = [w for w in waiting if (w[0], w[5]) in open_]
                if done:
                    yield rows(done, set())
                fills = {k: v for k, v in fills.items() if k in open_}
        if waiting:
            yield rows(waiting, now_open())

    # in the order of a hash, so that a lost task gives the same containers when it is run again
    spread = sized.withColumn("_order", F.xxhash64("doc_id")).repartition(partitions, "_order").sortWithinPartitions("_order", "doc_id", "budget_id")
    return spread.drop("_order").mapInArrow(run, _PLACED)


def _merge(left: DataFrame, capacities: dict[int, int], level: int) -> DataFrame:
    """(budget_id, container, group, merged, fill, left_open): leftover containers as items of merged ones."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("fill", "descending"), ("container", "ascending")])
        budget, group = t["budget_id"][0].as_py(), t["_group"][0].as_py()
        packer, fills, numbers = Packer(capacities[budget]), {}, []
        for fill in t["fill"].to_pylist():
            k = packer.put(fill)
            numbers.append(k)
            fills[k] = fills.get(k, 0) + fill
        open_ = {k for _, k in packer.open}
        return pa.table(
            {
                "budget_id": t["budget_id"], "container": t["container"], "part": pa.array([group] * len(t), pa.int32()), "merged": pa.array([f"m{level}-{group}-{k}" for k in numbers], pa.string()),
                "fill": pa.array([fills[k] for k in numbers], pa.int64()), "left_open": pa.array([k in open_ for k in numbers], pa.bool_()),
            }
        )

    grouped = left.withColumn("_group", F.floor(F.col("part") / FAN_IN).cast("int")).select("budget_id", "container", "fill", "_group")
    return grouped.groupBy("budget_id", "_group").applyInArrow(run, "budget_id int, container string, part int, merged string, fill bigint, left_open boolean")


def pack(sized: DataFrame, capacities: dict[int, int], partitions: int | None = None) -> DataFrame:
    """budget_id, container, doc_id, piece_no, start_token, n_tokens: every item of ``sized`` in a container.

    ``sized``: doc_id, budget_id, n_tokens (positive); doc_ids are unique within a budget. An item over the capacity is cut into full
    pieces and a rest; every other is whole (piece_no 0). No container exceeds the budget's capacity. An empty input
    gives an empty result. The result depends on the items and ``partitions`` only: the number of first tasks, by default that of the
    shuffle partitions. Leftovers of more than ``FAN_IN`` of them are merged in a further level.
    """
    partitions = partitions or max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = checkpointed(_place(sized, capacities, partitions))
    part = F.substring_index("container", "-", 1).cast("int")
    left = placed.filter("left_open").select("budget_id", "container", "fill", part.alias("part")).distinct()
    names, level, groups = None, 0, partitions
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        merged = checkpointed(_merge(left, capacities, level))
        step = merged.select("budget_id", F.col("container").alias("was"), F.col("merged").alias("now"))
        if names is None:
            names = step
        else:
            later = step.select("budget_id", F.col("was").alias("now"), F.col("now").alias("_next"))
            names = names.join(later, ["budget_id", "now"], "left").select("budget_id", "was", F.coalesce("_next", "now").alias("now"))
        if groups == 1:
            break
        left = merged.filter("left_open").select("budget_id", F.col("merged").alias("container"), "fill", "part").distinct()
    final = placed.join(names.withColumnRenamed("was", "container"), ["budget_id", "container"], "left")
    return final.select("budget_id", F.coalesce("now", "container").alias("container"), "doc_id", "piece_no", "start_token", "n_tokens")


def pack_budgets(budgets: DataFrame) -> list[tuple[int, str, int]]:
    """(budget_id, tokenizer, capacity) of the ``pack`` rows of token_budgets, a table of a few rows that doesn't grow."""
    rows = budgets.filter("purpose = 'pack' and capacity_tokens > 0").select("budget_id", "tokenizer", "capacity_tokens").distinct().orderBy("budget_id")
    return [tuple(r) for r in rows.collect()]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    budgets = pack_budgets(table(spark, d, "token_budgets"))
    return pack(sized_documents(table(spark, d, "documents"), budgets), {b: c for b, _, c in budgets})


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: containers, tokens, share of the room that is used, and the fewest containers possible at all."""
    budgets = spark.createDataFrame(pack_budgets(table(spark, d, "token_budgets")), "budget_id int, tokenizer string, capacity int")
    total = p7_containers(spark, d).groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("fill")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return total.join(budgets, "budget_id").select("budget_id", "containers", "tokens", (F.col("tokens") / room).alias("used"), F.ceil(F.col("tokens") / F.col("capacity")).alias("at_least"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
