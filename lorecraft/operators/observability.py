"""Dashboards over runs, event traces and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The states of a run.
STATES = ["queued", "running", "waiting_approval", "completed", "failed", "cancelled"]
TERMINAL = ["completed", "failed", "cancelled"]


def rate(part: Column, whole: Column) -> Column:
    """part / whole to six places; null where whole is 0."""
    return F.round(F.try_divide(part, whole), 6)


def selected(runs: DataFrame, since: str | None = None, status: str | None = None, skill: str | None = None, source: str | None = None) -> DataFrame:
    """Runs of a window with these properties: the filter of every metric."""
    if since:
        runs = runs.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    for column, value in (("status", status), ("skill", skill), ("source", source)):
        if value:
            runs = runs.filter(F.col(column) == value)
    return runs


def dashboard(runs: DataFrame, by: list[str]) -> DataFrame:
    """Totals, rates, steps and the nearest-rank 95th percentile of the durations of finished runs."""
    done = F.col("status").isin(TERMINAL)
    told = runs.groupBy(*by).agg(
        F.count("*").alias("total_runs"), F.count_if(done).alias("terminal_runs"), F.count_if(F.col("status") == "completed").alias("successful_runs"),
        F.count_if(F.col("retries") > 0).alias("retrying_runs"), F.round(F.avg("steps"), 6).alias("average_steps"), F.count_if(F.col("approvals") > 0).alias("approval_runs"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN status IN ('completed', 'failed', 'cancelled') AND duration_ms >= 0 THEN duration_ms END)").alias("p95_duration_ms"),
    )
    return told.select(
        "*", rate(F.col("successful_runs"), F.col("terminal_runs")).alias("success_rate"), rate(F.col("retrying_runs"), F.col("total_runs")).alias("retry_rate"),
        rate(F.col("approval_runs"), F.col("total_runs")).alias("approval_rate"),
    )


def status_distribution(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """A row for each state, also for those without runs."""
    counts = runs.groupBy("status").agg(F.count("*").alias("n"))
    states = spark.createDataFrame([(s,) for s in STATES], "status string")
    told = states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("runs"))
    return told.withColumn("rate", rate(F.col("runs"), F.sum("runs").over(Window.partitionBy(F.lit(1)))))


def error_distribution(runs: DataFrame) -> DataFrame:
    """(error_code, n, rate) over all runs; grouped first, so the window sees a row for each code."""
    counts = runs.groupBy("error_code").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", rate(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1))))).filter("error_code IS NOT NULL")


def trace_events(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """events with their number within the run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def run_upsert(updates: DataFrame, run: str, order: str) -> DataFrame:
    """One row for each run: first seen, last state, highest approval count, updates."""
    return updates.groupBy(run).agg(F.min(order).alias("created"), F.max_by("status", order).alias("status"), F.max("approvals").alias("approvals"), F.count("*").alias("updates"))


def tail(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)


def budget_admission(requests: DataFrame, by: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """requests with what was used before them and whether they were admitted: while less than cap was used."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return requests.withColumn("used_before", F.round(before, 6)).withColumn("admitted", F.round(before, 6) < cap)


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median, nearest-rank 95th percentile and maximum, to two places."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.median(value), 2).alias("median"),
        F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})"), 2).alias("p95"), F.round(F.max(value), 2).alias("most"),
    )


def adoption_gate(baseline: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """(by, failures): metrics that fell, and whether none of hit_at_1 and mrr rose."""
    b = baseline.select(by, *[F.col(c).alias(f"b_{c}") for c in ("hit_at_1", "recall", "mrr")])
    fell = [F.when(F.col(c) < F.col(f"b_{c}"), f"{c}_regressed") for c in ("hit_at_1", "recall", "mrr")]
    gain = F.when((F.col("hit_at_1") <= F.col("b_hit_at_1")) & (F.col("mrr") <= F.col("b_mrr")), "no_top_rank_gain")
    return candidate.join(b, by).select(by, F.array_join(F.array_compact(F.array(*fell, gain)), ",").alias("failures"))
