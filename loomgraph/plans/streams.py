"""Streaming queries, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.streaming import events as e


def stream_windowed_counts(spark, d):
    out = e.finished(e.windowed_counts(e.source(spark, d), late=e.span(spark, d)), "update", ["started", "event_type"])
    return out.withColumn("started", F.col("started").cast("timestamp_ntz"))


def stream_buffer_replay(spark, d):
    return e.finished(e.buffered(e.source(spark, d).withColumn("user_id", F.col("user_id").cast("bigint"))), "update", ["user_id", "place"]).select("user_id", "event_id", "place")


def stream_distinct_events(spark, d):
    return e.finished(e.distinct_events(e.source(spark, d), e.span(spark, d)).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count("*").alias("events"))


def _delivered(spark, d):
    events = e.source(spark, d).withColumn("user_id", F.col("user_id").cast("bigint"))
    return e.finished(e.delivered(events, "signup", ("purchase",), timeout=3 * 86400), "append")


def stream_delivery(spark, d):
    """Listeners connect with a signup, a purchase ends a stream, and a listener is dropped after three days."""
    return _delivered(spark, d)


def stream_active_count(spark, d):
    return e.open_streams(_delivered(spark, d))


def stream_daily_usage(spark, d):
    """Events of each day and type, as the day's last update."""
    out = e.finished(e.windowed_counts(e.source(spark, d), "1 day", e.span(spark, d)), "update", ["started", "event_type"])
    return out.select(F.to_date("started").alias("day"), "event_type", "events")


QUERIES = {
    f.__name__: f for f in (stream_windowed_counts, stream_buffer_replay, stream_distinct_events, stream_delivery, stream_active_count, stream_daily_usage)
}
SQL = {
    "stream_windowed_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_buffer_replay": "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) t WHERE place <= 100",
    "stream_distinct_events": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "stream_daily_usage": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
