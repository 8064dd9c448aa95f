"""Streams of events: windows, deduplication, and for each key a bounded buffer that is replayed to a listener.

``finished`` runs a stream over what is there now and returns its sink as a table: in tests and for the SQL check. A
service starts the same streams with a trigger of its own. Results don't depend on how the events are cut into files and
micro-batches: what is late is told by the event times, and a replay of a whole table allows for all of its span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from loomgraph.session import scratch

#: The first so many events of a key are kept until somebody listens; later ones are dropped.
BUFFER = 100
#: A listener is dropped so many seconds after it connected, and the state of a key after as many without an event.
TIMEOUT = 300


def source(spark: SparkSession, d: str, name: str = "events", time: str = "ts", files: int = 64) -> DataFrame:
    """A table of the data directory as a stream; event times get a zone, which watermarks need."""
    schema = spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files))
    return stream.parquet(f"{d.rstrip('/')}/{name}.parque[t]").withColumn(time, F.col(time).cast("timestamp"))


def span(spark: SparkSession, d: str, name: str = "events", time: str = "ts") -> str:
    """How late an event of a table can be if it is replayed in any order: its whole span, as an interval."""
    row = spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet").agg(F.timestamp_diff("SECOND", F.min(time), F.max(time)).alias("s")).first()
    return f"{(row['s'] or 0) + 1} seconds"


def finished(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream until its input is used up. Mode ``append`` collects all rows; ``update`` the last ones for the keys."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:06d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    if mode == "append":
        return rows.drop("_batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and sum of values of each tumbling window and type; what is later than ``late`` is left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("started"), "event_type", "events", "total")


def buffered(events: DataFrame, key: str = "user_id", limit: int = BUFFER) -> DataFrame:
    """The first ``limit`` events of each key by time and id, numbered; the state of a key is these events.

    Mode ``update``: a place is given again when an earlier event arrives later.
    """

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids = state.get if state.exists else ([], [])
        held = sorted(zip(times, ids))
        first = held
        for batch in batches:
            first = sorted(set(first) | set(zip(batch["ts"].astype("int64").tolist(), batch["event_id"].tolist())))[:limit]
        state.update(([t for t, _ in first], [i for _, i in first]))
        at = [n for n, x in enumerate(first) if n >= len(held) or held[n] != x]
        yield pd.DataFrame({key: [k[0]] * len(at), "event_id": [first[n][1] for n in at], "place": [n + 1 for n in at]})

    slim = events.select(key, "event_id", "ts").filter(F.col(key).isNotNull())
    return slim.groupBy(key).applyInPandasWithState(keep, f"{key} bigint, event_id bigint, place int", "times array<bigint>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


def delivered(events: DataFrame, connect: str, ends: tuple[str, ...], key: str = "user_id", limit: int = BUFFER, timeout: int = TIMEOUT, expire: bool = False) -> DataFrame:
    """What the listener of each key gets: key, seq, kind and event_id, in order of ``seq``.

    Events of type ``connect`` connect a listener: it gets ``connected``, then ``replayed`` for each event that was buffered
    (the first ``limit`` since the last one left, newer ones were dropped), then ``live`` for each event that comes. An event of a
    type in ``ends`` is delivered as ``closed`` and ends the connection, and clears the buffer also where nobody listens. A
    listener is dropped ``timeout`` seconds after it connected, which is told when the next event comes (kind ``timeout``, with
    that event, which is buffered); a second listener takes the place of the first. State is a few numbers and the buffer; it is cleared
    at an end, and with ``expire`` where no event has come for ``timeout`` seconds of processing time (for a stream that goes on: one
    with such clocks never finishes what is available now).

    Events of one micro-batch are taken in order of time and id; those of different ones as they come.
    """
    names = [key, "seq", "kind", "event_id"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, seq, held = state.get if state.exists else (None, 0, [])
        held, out = list(held), []

        def tell(kind: str, event: int) -> None:
            nonlocal seq
            seq += 1
            out.append((k[0], seq, kind, event))

        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for at, event, kind in zip((rows["ts"].astype("int64") // 10**3).tolist(), rows["event_id"].tolist(), rows["event_type"].tolist()):
            if since is not None and at > since + timeout * 10**6:
                tell("timeout", event)
                since = None
            if kind == connect:
                tell("connected", event)
                for earlier in held:
                    tell("replayed", earlier)
                since, held = at, []
            elif kind in ends:
                if since is not None:
                    tell("closed", event)
                since, held = None, []
            elif since is not None:
                tell("live", event)
            elif len(held) < limit:
                held.append(event)
        state.update((since, seq, held))
        if expire:
            state.setTimeoutDuration(timeout * 1000)
        yield pd.DataFrame(out, columns=names)

    slim = events.select(key, "event_id", "event_type", "ts").filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    clock = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return slim.groupBy(key).applyInPandasWithState(run, f"{key} bigint, seq bigint, kind string, event_id bigint", "since bigint, seq bigint, held array<bigint>", "append", clock)


def open_streams(told: DataFrame, key: str = "user_id") -> DataFrame:
    """One row, ``active``: the number of keys whose last row of ``delivered`` is no end of a connection."""
    last = told.groupBy(key).agg(F.max_by("kind", "seq").alias("kind"))
    return last.agg(F.count_if(~F.col("kind").isin("closed", "timeout")).alias("active"))


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event_id once, if its copies come within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
