"""Measures of agents and model calls: grouped KPIs, rankings and windows of time.

``now`` is a column, a literal or a one-row DataFrame's scalar: nothing reads the clock, so that results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(df: DataFrame, time: str, now: Column, days: float) -> DataFrame:
    """Rows of the last ``days`` before ``now``."""
    return df.filter(F.col(time) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0)))


def last_time(df: DataFrame, time: str) -> Column:
    """The latest time of a table as a scalar, never collected. Give the table as it is: repeated rows change nothing, and making them unique costs a shuffle."""
    return df.agg(F.max(time)).scalar()


def agent_performance(executions: DataFrame) -> DataFrame:
    """By agent: runs, latency and tokens of a run (null where either count is), successes, failures and success rate."""
    tokens = F.col("token_usage_input") + F.col("token_usage_output")
    ok = F.count_if(F.col("status") == "SUCCESS")
    return executions.groupBy("agent_name").agg(
        F.count("*").alias("executions"),
        F.avg("latency_ms").alias("avg_latency"),
        F.max("latency_ms").alias("max_latency"),
        F.min("latency_ms").alias("min_latency"),
        F.avg(tokens).alias("avg_tokens"),
        ok.alias("successes"),
        F.count_if(F.col("status") == "FAILED").alias("failures"),
        F.round(ok * 100.0 / F.count("*"), 2).alias("success_rate"),
    )


def token_usage(executions: DataFrame) -> DataFrame:
    i, o = F.coalesce(F.sum("token_usage_input"), F.lit(0)), F.coalesce(F.sum("token_usage_output"), F.lit(0))
    return executions.groupBy("agent_name").agg(i.alias("tokens_in"), o.alias("tokens_out"), (i + o).alias("tokens"))


def decision_breakdown(executions: DataFrame) -> DataFrame:
    return executions.filter("decision is not null").groupBy("agent_name", "decision").agg(F.count("*").alias("n"), exact_average("confidence").alias("avg_confidence"))


def call_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, cost, latency (of measured calls) and error rate by the given columns; of all with none."""
    failed = F.count_if(~F.col("success"))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("tokens_in"),
        F.sum("output_tokens").alias("tokens_out"),
        F.sum("total_tokens").alias("tokens"),
        F.sum(F.col("estimated_cost").cast("decimal(18,8)")).cast("double").alias("cost"),
        F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))).alias("avg_latency"),
        failed.alias("failed"),
        F.round(failed * 100.0 / F.count("*"), 2).alias("error_rate"),
    )


def exact_average(column: str) -> Column:
    """Average of decimal fractions: their sum is exact, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(12,4)")).cast("double") / F.nullif(F.count(column), F.lit(0))


SCORES = ("context_relevance_score", "answer_relevance_score", "faithfulness_score", "response_quality_score")


def quality_scores(calls: DataFrame) -> DataFrame:
    """Average quality scores of successful calls by agent."""
    return calls.filter("success").groupBy("agent_name").agg(*(exact_average(c).alias(c) for c in SCORES))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only ``k`` of each in every task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def slowest(executions: DataFrame, k: int) -> DataFrame:
    return executions.filter("latency_ms is not null").orderBy(F.desc("latency_ms"), "id").limit(k)


def derived_calls(calls: DataFrame) -> DataFrame:
    """Tokens per second (0 where nothing was measured) and the sum of tokens of each call."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.select("id", total.alias("tokens"), F.round(F.when(F.col("latency_ms") > 0, total * 1000.0 / F.col("latency_ms")).otherwise(0.0), 4).alias("tokens_per_second"))


def rolling_usage(calls: DataFrame, days: int) -> DataFrame:
    """By agent and day: calls of that day and of the last ``days`` calendar days with calls up to it."""
    daily = calls.groupBy("agent_name", F.to_date("call_ts").alias("day")).agg(F.count("*").alias("calls"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("agent_name").orderBy(number).rangeBetween(-(days - 1), 0)
    return daily.filter("day is not null").withColumn("rolling_calls", F.sum("calls").over(frame))


def sessions(calls: DataFrame, gap_minutes: int) -> DataFrame:
    """Runs of calls of a conversation without a pause of more than ``gap_minutes``: start, end and number of calls.

    ``calls``: id, conversation_id, call_ts. Pauses are found within each hour of a conversation, so that one with a third
    of all rows is no single task's; what is carried from hour to hour, the last time and the number of sessions so far,
    is a row for each hour with calls.
    """
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    rows = calls.filter("conversation_id is not null").withColumn("_hour", F.date_trunc("hour", "call_ts"))
    order = Window.partitionBy("conversation_id", "_hour").orderBy("call_ts", "id")
    pause = F.coalesce(F.col("call_ts") > F.lag("call_ts").over(order) + gap, F.lit(False)).cast("int")
    parts = rows.withColumn("_pause", pause).withColumn("_part", F.sum("_pause").over(order))
    parts = parts.groupBy("conversation_id", "_hour", "_part").agg(F.min("call_ts").alias("_from"), F.max("call_ts").alias("_to"), F.count("*").alias("_n"))
    along = Window.partitionBy("conversation_id").orderBy("_hour", "_part")
    new = F.coalesce(F.col("_from") > F.lag("_to").over(along) + gap, F.row_number().over(along) == 1).cast("int")
    numbered = parts.withColumn("_new", new).withColumn("session", F.sum("_new").over(along))
    return numbered.groupBy("conversation_id", "session").agg(F.min("_from").alias("started"), F.max("_to").alias("ended"), F.sum("_n").alias("calls"))


def agent_stats(calls: DataFrame) -> DataFrame:
    """One row for each agent: calls, failures, tokens, cost, latency, success rate and average scores of successful calls."""
    ok = F.col("success")
    score = lambda c: F.sum(F.when(ok, F.col(c).cast("decimal(12,4)"))).cast("double") / F.nullif(F.count(F.when(ok, F.col(c))), F.lit(0))
    return calls.groupBy("agent_name").agg(
        F.count("*").alias("calls"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.col("estimated_cost").cast("decimal(18,8)")).cast("double"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency"),
        F.round(F.count_if(ok) * 100.0 / F.count("*"), 2).alias("success_rate"),
        *(score(c).alias(c) for c in SCORES),
    )
