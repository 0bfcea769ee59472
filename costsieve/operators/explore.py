"""Exploratory cost aggregates over ingested CUR data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costsieve.session import materialise

EXACT_ROWS = 50_000


def cost_by_service(df: DataFrame) -> DataFrame:
    """Total cost per service, descending."""
    return df.groupBy("service").agg(F.sum("cost").alias("cost")).orderBy(F.col("cost").desc(), "service")


def top_resources(df: DataFrame, n: int = 10) -> DataFrame:
    """The n costliest resources, blank ids excluded (top-k report)."""
    return (df.where(F.col("resource_id") != "").groupBy("resource_id").agg(F.sum("cost").alias("cost"))
            .orderBy(F.col("cost").desc(), "resource_id").limit(n))


def inefficient_resources(df: DataFrame, q: float = 0.9, n: int = 10) -> DataFrame:
    """Rows whose cost per unit (cost / (usage + 0.001)) is above its exact q-quantile,
    summed per (service, resource_id); the n costliest."""
    # read several times (quantile, then the filter): written once instead of re-running the
    # ingest, which also pins the float values that the threshold is compared with
    per_unit = materialise(
        df.select("service", "resource_id", "cost", (F.col("cost") / (F.col("usage") + F.lit(0.001))).alias("cost_per_unit")), "per-unit")
    threshold = bracketed_quantile(per_unit, "cost_per_unit", q)
    hot = per_unit.where(F.col("cost_per_unit") > F.lit(threshold).cast("double"))
    return (hot.groupBy("service", "resource_id").agg(F.sum("cost").alias("cost"))
            .orderBy(F.col("cost").desc(), "service", "resource_id").limit(n))


def bracketed_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact q-quantile with linear interpolation, None without values.

    ``percentile_approx`` gives values on both sides of the wanted ranks; one aggregate counts
    how many values lie below and inside them, and the bracket is narrowed until it holds few
    enough values for a top-k; an end value that holds too much of the bracket is counted and taken off.
    Each round is two aggregates over one column; no values are sorted but those of the last
    bracket, and no more than EXACT_ROWS of them are collected.
    """
    values = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("x"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = q * (n - 1)
    first, last = int(at), min(int(at) + 1, n - 1)
    below, inside = 0, n
    while inside > EXACT_ROWS and low < high:
        here = values.where((F.col("x") >= low) & (F.col("x") <= high))
        share = [max(0.0, (first - below) / inside - 0.001), min(1.0, (last - below + 1) / inside + 0.001)]
        a, b = here.agg(F.percentile_approx("x", share, 10_000)).first()[0]
        less, upto = here.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
        new_low, new_high = (a if below + less <= first else low), (b if below + upto > last else high)
        if (new_low, new_high) == (low, high):  # an end holds a large part of the bracket: it is taken off
            x = F.col("x")
            at_low, at_high, next_low, next_high = here.agg(
                F.count_if(x == low), F.count_if(x == high), F.min(F.when(x > low, x)), F.max(F.when(x < high, x))).first()
            if last < below + at_low:
                return low
            if first >= below + inside - at_high:
                return high
            if first < below + at_low:
                return low + (next_low - low) * (at - first)
            if last >= below + inside - at_high:
                return next_high + (high - next_high) * (at - first)
            below, inside, low, high = below + at_low, inside - at_low - at_high, next_low, next_high
            continue
        below += less if new_low == a else 0
        low, high = new_low, new_high
        inside = values.where((F.col("x") >= low) & (F.col("x") <= high)).count()
    # distinct values with their counts, smallest first: enough of them to reach the last rank
    counted = values.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ends, seen = {}, below
    for x, k in counted.orderBy("x").limit(min(last - below + 1, EXACT_ROWS)).collect():
        for rank in (first, last):
            if seen <= rank < seen + k:
                ends[rank] = x
        seen += k
        if last in ends:
            break
    return ends[first] + (ends[last] - ends[first]) * (at - first)


def daily_total(df: DataFrame) -> DataFrame:
    """I4: cost per day."""
    return df.groupBy("date").agg(F.sum("cost").alias("cost"))


def daily_service_pivot(df: DataFrame) -> DataFrame:
    """Day x service cost matrix, missing cells 0, one column for each service that the
    table holds (a catalogue-sized list, which Spark looks up)."""
    return df.groupBy("date").pivot("service").agg(F.sum("cost")).na.fill(0.0)


def service_usage_types(df: DataFrame, service: str = "EC2") -> DataFrame:
    """One service's cost by usage type, descending."""
    return (df.where(F.col("service") == service).groupBy("usage_type").agg(F.sum("cost").alias("cost"))
            .orderBy(F.col("cost").desc(), "usage_type"))


def pipeline_projection(df: DataFrame, provider: str = "AWS") -> DataFrame:
    """The 6 columns the normalizer needs, plus the provider."""
    return df.select("date", "service", "cost", "usage", "resource_id", "region").withColumn(
        "provider", F.lit(provider))
