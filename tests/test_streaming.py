import datetime as dt
import random

from loomgraph.streaming import events as e

SCHEMA = "event_id bigint, user_id bigint, event_type string, ts timestamp, value double"


def written(spark, tmp_path, rows, files=4):
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(str(tmp_path / "in" / "events.parquet"))
    return str(tmp_path / "in")


def test_buffer_keeps_the_first_hundred_whatever_the_files(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, 7, "view", t + dt.timedelta(seconds=i), 1.0) for i in range(130)] + [(1000, 8, "view", t, 1.0), (1001, None, "view", t, 1.0)]
    d = written(spark, tmp_path, rows, 7)
    kept = e.finished(e.buffered(e.source(spark, d, files=2)), "update", ["user_id", "place"]).collect()
    assert sorted((r.user_id, r.place, r.event_id) for r in kept) == [(7, i + 1, i) for i in range(100)] + [(8, 1, 1000)]


def test_windows_of_many_files(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    d = written(spark, tmp_path, [(i, 7, "view", t + dt.timedelta(hours=i % 90), 1.0) for i in range(360)], 9)
    counts = e.finished(e.windowed_counts(e.source(spark, d, files=2), late=e.span(spark, d)), "update", ["started", "event_type"]).collect()
    assert len(counts) == 90 and {r.events for r in counts} == {4}
    assert e.finished(e.distinct_events(e.source(spark, d, files=2), e.span(spark, d)).select("event_id", "event_type"), "append").count() == 360


def brute_force(rows, connect, ends, limit, timeout):
    out = []
    for user in sorted({r[1] for r in rows}):
        since, held, seq = None, [], 0
        for event, _, kind, at, _ in sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])):
            told = []
            if since is not None and (at - since).total_seconds() > timeout:
                told.append(("timeout", event))
                since = None
            if kind == connect:
                told += [("connected", event), *(("replayed", h) for h in held)]
                since, held = at, []
            elif kind in ends:
                told += [("closed", event)] if since else []
                since, held = None, []
            elif since:
                told.append(("live", event))
            else:
                held = [*held, event][:limit]
            for k, i in told:
                seq += 1
                out.append((user, seq, k, i))
    return out


def test_delivery_against_brute_force(spark, tmp_path):
    r, t = random.Random(3), dt.datetime(2025, 1, 1)
    rows = [(i, r.randint(1, 5), r.choice(["view"] * 8 + ["in", "out"]), t + dt.timedelta(seconds=r.randint(0, 4000)), 1.0) for i in range(400)]
    told = e.finished(e.delivered(e.source(spark, written(spark, tmp_path, rows)), "in", ("out",), limit=5, timeout=300), "append")
    want = brute_force(rows, "in", ("out",), 5, 300)
    assert {"timeout", "connected", "replayed", "closed", "live"} == {w[2] for w in want}
    assert sorted((x.user_id, x.seq, x.kind, x.event_id) for x in told.collect()) == want
    last = {w[0]: w[2] for w in want}
    assert e.open_streams(told).first().active == sum(k not in ("closed", "timeout") for k in last.values())
