import datetime as dt

import numpy as np
import pandas as pd
import pytest
from loomgraph.llm import quantiles as q


def summary(values, eps):
    n, width, sizes, v, g = q.summarise(np.array(values, float), np.zeros(len(values), int), eps)
    return int(n[0]), int(width[0]), v, g, np.zeros(len(g), np.int64)


def off(values, answer, p):
    """Ranks between the answer and the exact one; 0 if equal values make them meet."""
    values, target = np.sort(values), max(1, int(np.ceil(p * len(values) - 1e-9)))
    low, high = np.searchsorted(values, answer, "left") + 1, np.searchsorted(values, answer, "right")
    assert high >= low, "not one of the values"
    return max(0, low - target, target - high)


@pytest.mark.parametrize("seed", range(6))
def test_merged_summaries_keep_their_bound(seed):
    rng = np.random.default_rng(seed)
    eps, parts = 0.01, []
    for _ in range(rng.integers(2, 40)):
        x = rng.lognormal(5, 2, rng.integers(1, 3000)).round()
        x[rng.random(len(x)) < 0.3] = rng.choice([0, 500, 1000])
        parts.append(x)
    whole = np.concatenate(parts)
    done = [summary(x, eps / 2) for x in parts]
    half = len(done) // 2
    done = [q.merge_all(own, eps * q.LEVELS[0], eps * q.LEVELS[1]) for own in (done[:half], done[half:])]
    done = [q.merge_all(done, eps * q.LEVELS[1], eps)]
    n, width, v, g, delta = done[0]
    assert n == len(whole) == g.sum() and width <= max(1, 2 * eps * n) and v[0] == whole.min() and v[-1] == whole.max()
    assert len(v) < 8 / eps
    low = np.cumsum(g)
    at = np.searchsorted(np.sort(whole), v, "right")
    assert (low <= at).all() and (low + delta >= np.searchsorted(np.sort(whole), v, "left") + 1).all()
    for p in (0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 1):
        assert off(whole, q.quantile(done[0], p), p) <= width // 2


def test_query_on_tables(spark, data):
    d = data("sf0.001")
    got = q.p4_percentiles(spark, d).toPandas()
    calls = pd.read_parquet(f"{d}/llm_call_metrics.parquet").drop_duplicates("id")
    for r in got.itertuples():
        x = calls[(calls.agent_name == r.agent_name) & (calls.model == r.model)][r.measure].dropna()
        x = x[x != -1]
        assert len(x) == r.n and r.rank_error <= r.rank_bound and off(x.to_numpy(), r.value, r.p) <= r.rank_error
    days = q.p4_daily(spark, d).toPandas()
    for r in days.sample(200, random_state=1).itertuples():
        x = calls[(calls.agent_name == r.agent_name) & (calls.model == r.model) & (calls.call_ts.dt.date == r.day)][r.measure].dropna()
        x = x[x != -1]
        assert len(x) == r.n and r.rank_error <= r.rank_bound and off(x.to_numpy(), r.value, r.p) <= r.rank_error
    assert len(got) == 4 * sum(len(g[m].dropna()[lambda x: x != -1]) > 0 for _, g in calls.groupby(["agent_name", "model"]) for m in ("latency_ms", "total_tokens"))


def test_nulls_repeats_and_ties(spark):
    schema = "id bigint, agent_name string, model string, call_ts timestamp_ntz, latency_ms bigint, total_tokens int, n string"
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "a", "m", t, 5, None, "x"), (1, "a", "m", t, 5, None, "y"), (2, "a", "m", None, 5, -1, "x"), (3, None, "m", t, -1, 0, "x"), (4, None, None, t, None, None, None)]
    got = {(r.agent_name, r.model, r.measure, r.p): (r.value, r.n) for r in q.percentiles(q.daily_summaries(q.call_measures(spark.createDataFrame(rows, schema)), q.KEYS), q.KEYS).collect()}
    assert got == {("a", "m", "latency_ms", p): (5.0, 2) for p in q.PERCENTILES} | {(None, "m", "total_tokens", p): (0.0, 1) for p in q.PERCENTILES}
    empty = spark.createDataFrame([], schema)
    assert q.percentiles(q.daily_summaries(q.call_measures(empty), q.KEYS), q.KEYS).count() == 0


def test_levels_against_exact_ranks(spark, data):
    """On the largest tables, where summaries are really compressed: every answer for all time and single months within its tracked error."""
    d = data("sf0.1")
    got = q.p4_levels(spark, d).filter("period <> 'day'").toPandas()
    calls = pd.read_parquet(f"{d}/llm_call_metrics.parquet", columns=["id", "agent_name", "model", "call_ts", *("latency_ms", "total_tokens")]).drop_duplicates("id")
    long = calls.melt(["agent_name", "model", "call_ts"], ["latency_ms", "total_tokens"], "measure").dropna(subset=["value"]).query("value != -1")
    long["since"] = long.call_ts.dt.to_period("M").dt.start_time.dt.date
    whole = dict(list(long.groupby(["agent_name", "model", "measure"]).value))
    months = dict(list(long.groupby(["agent_name", "model", "measure", "since"]).value))
    checked = 0
    for r in got.itertuples():
        x = (whole if r.period == "all" else months).get((r.agent_name, r.model, r.measure, *(() if r.period == "all" else (r.since,))))
        if x is not None:  # groups with a null key are checked above
            assert len(x) == r.n and r.rank_error <= r.rank_bound and off(x.to_numpy(), r.value, r.p) <= r.rank_error
            checked += 1
    assert checked > 1000
    big = got[(got.period == "all") & (got.n >= 5 / q.EPS)]
    assert len(big) and (big.tuples < big.n / 4).all() and (big.rank_error > 0).any()
