"""Dedupe, score, rank and summarise leaks.

The leak table is small next to the billing rows (at most a few rows per resource), and
every step here is a per-leak expression, a join against the per-service / per-resource
aggregates, or an aggregate keyed by the leak key. Nothing is numbered with a global
window: the report order is a sortable struct (``rank_key``); positions, when needed,
come from ``ranking.global_positions``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve import schema as S
from costsieve.functions import has_text, money
from costsieve.functions.categories import contains_any
from costsieve.operators.features import RESOURCE_KEYS, SERVICE_KEYS
from costsieve.operators.ranking import join_back

LEAK_KEY = ["leak_type", "provider", "service", "resource_id"]


def _map_expr(col: Column, mapping: dict, default) -> Column:
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(col == k, F.lit(v)).otherwise(expr)
    return expr


def to_leak_schema(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LEAK.fields])


def union_leaks(frames: list[DataFrame]) -> DataFrame:
    """Concatenate detector outputs in LEAK shape (missing columns become NULL)."""
    frames = [to_leak_schema(f) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- F1
def dedupe_leaks(leaks: DataFrame) -> DataFrame:
    """One row per (leak_type, provider, service, resource_id), first in detector order.

    Null keys group together (as Python tuples compare equal). An aggregate, not a window:
    partial aggregation keeps a repeated key from gathering in one task.
    """
    rest = [c for c in leaks.columns if c not in LEAK_KEY]
    picked = leaks.groupBy(*LEAK_KEY).agg(
        F.min_by(F.struct(*rest), F.struct("detector_rank", "order_num", "order_seq")).alias("_r"))
    return picked.select(*LEAK_KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- F2..F5
def severity_score(reason: Column, leak_type: Column, days_active: Column, z_score: Column) -> Column:
    text = F.lower(F.coalesce(reason, F.lit("")))
    score = _map_expr(leak_type, S.LEAK_TYPE_WEIGHTS, 0)
    for words, points in S.REASON_BONUSES:
        score = score + F.when(contains_any(text, words), F.lit(points)).otherwise(F.lit(0))
    days = F.coalesce(days_active, F.lit(0))
    score = score + F.when(days >= 30, 15).when(days >= 14, 8).otherwise(0)
    # z > 3 adds 15; the reference's second tier (z > 5.5 after z <= 3) can never fire
    score = score + F.when(z_score.isNotNull() & (z_score > 3.0), 15).otherwise(0)
    score = score - F.when(leak_type.isin(*S.LOW_SIGNAL_PENALTY["types"]), S.LOW_SIGNAL_PENALTY["points"]).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def severity_label(score: Column) -> Column:
    expr = F.lit("LOW")
    for threshold, label in reversed(S.SEVERITY_LABELS):
        expr = F.when(score >= threshold, F.lit(label)).otherwise(expr)
    return expr


def recommended_action(severity: Column) -> Column:
    return _map_expr(severity, S.SEVERITY_ACTIONS, S.SEVERITY_ACTIONS["LOW"])


def monthly_waste(leak_type: Column, exact_waste: Column, avg_daily_cost: Column) -> Column:
    """Carried value when non-zero (idle DB, RI totals); else service mean daily cost x 30 x
    the type's multiplier, rounded to cents."""
    mult = _map_expr(leak_type, S.WASTE_MULTIPLIERS, S.DEFAULT_WASTE_MULTIPLIER)
    estimate = money(F.coalesce(avg_daily_cost, F.lit(0.0)) * 30 * mult)
    carried = F.when(exact_waste.isNotNull() & (exact_waste != 0), exact_waste)
    return F.coalesce(carried, estimate)


def confidence(leak_type: Column, days_active: Column, avg_daily_cost: Column, z_score: Column) -> Column:
    days = F.coalesce(days_active, F.lit(0))
    avg = F.coalesce(avg_daily_cost, F.lit(0.0))
    return (
        F.when((days >= 14) & (avg > 0), "HIGH")
        .when((days >= 7) | ((avg > 0) & z_score.isNotNull()), "MEDIUM")
        .when(leak_type.isin(*S.RI_TYPES), "HIGH")
        .otherwise("LOW")
    )


def rank_key() -> Column:
    """Report order: score desc, monthly waste desc, then detector order (stable)."""
    return F.struct(
        (-F.col("severity_score")).alias("a"), (-F.col("estimated_monthly_waste")).alias("b"),
        F.col("detector_rank").alias("c"), F.col("order_num").alias("d"), F.col("order_seq").alias("e"),
        F.col("provider").alias("f"), F.col("service").alias("g"), F.col("resource_id").alias("h"),
    )


def score_leaks(leaks: DataFrame, svc_stats: DataFrame | None, lifespan: DataFrame | None) -> DataFrame:
    """SCORED rows: LEAK + days_active, avg_daily_cost, severity_score, severity,
    recommended_action, estimated_monthly_waste, estimated_annual_waste, confidence, rank_key."""
    out = leaks
    if svc_stats is not None:
        out = join_back(out, svc_stats.select(*SERVICE_KEYS, "avg_daily_cost"), SERVICE_KEYS, "left")
    else:
        out = out.withColumn("avg_daily_cost", F.lit(None).cast("double"))
    if lifespan is not None:
        out = join_back(out, lifespan.select(*RESOURCE_KEYS, "days_active"), RESOURCE_KEYS, "left")
    else:
        out = out.withColumn("days_active", F.lit(None).cast("long"))
    lt, z = F.col("leak_type"), F.col("z_score")
    # two selects instead of a withColumn chain (each withColumn re-analyses the plan)
    out = out.select(
        "*",
        severity_score(F.col("reason"), lt, F.col("days_active"), z).alias("severity_score"),
        monthly_waste(lt, F.col("exact_waste"), F.col("avg_daily_cost")).alias("estimated_monthly_waste"),
        confidence(lt, F.col("days_active"), F.col("avg_daily_cost"), z).alias("confidence"),
    )
    sev = severity_label(F.col("severity_score"))
    return out.select(
        "*", sev.alias("severity"), recommended_action(sev).alias("recommended_action"),
        money(F.col("estimated_monthly_waste") * 12).alias("estimated_annual_waste"),
        rank_key().alias("rank_key"),
    )


# ---------------------------------------------------------------- F7
def primary_key() -> Column:
    return F.when(has_text("resource_id"), F.col("resource_id")).otherwise(
        F.concat(F.coalesce(F.col("provider"), F.lit("None")), F.lit(":"),
                 F.coalesce(F.col("service"), F.lit("None"))))


def select_primary(scored: DataFrame) -> DataFrame:
    """Best leak per resource (or per provider:service when the id is empty): score desc,
    type priority desc, waste desc, then report order. ``first_key`` is the report
    position of the key's first leak, which orders the primary list."""
    cols = [c for c in scored.columns if c != "rank_key"]
    prio = _map_expr(F.col("leak_type"), S.LEAK_PRIORITY, 0)
    best = F.struct((-F.col("severity_score")).alias("a"), (-prio).alias("b"),
                    (-F.col("estimated_monthly_waste")).alias("c"), F.col("rank_key").alias("d"))
    g = scored.withColumn("primary_key", primary_key()).groupBy("primary_key").agg(
        F.min_by(F.struct(*cols, "rank_key"), best).alias("_p"),
        F.min("rank_key").alias("first_key"),
    )
    return g.select(*[F.col(f"_p.{c}").alias(c) for c in cols], F.col("_p.rank_key").alias("rank_key"),
                    "first_key", "primary_key")


# ---------------------------------------------------------------- F8, F9
def summary(primary: DataFrame) -> DataFrame:
    sev = F.col("severity")
    total = F.coalesce(F.sum("estimated_monthly_waste"), F.lit(0.0))
    return primary.agg(
        F.count(F.lit(1)).alias("total_leaks"),
        F.count_if(sev == "HIGH").alias("high"),
        F.count_if(sev == "MEDIUM").alias("medium"),
        F.count_if(sev == "LOW").alias("low"),
        money(total).alias("estimated_monthly_waste_usd"),
        money(total * 12).alias("estimated_annual_waste_usd"),
    )


def pipeline_stats(total: DataFrame, normalized: DataFrame, forecasts: DataFrame | None, provider: str,
                   llm_enabled: bool = False) -> DataFrame:
    """provider, total_records, normalized_records, forecast_services, llm_enabled (one row).
    ``total`` and ``normalized`` hold the counts, taken from aggregates that are there anyway."""
    spark = total.sparkSession
    parts = [total, normalized]
    if forecasts is not None:
        parts.append(forecasts.agg(F.count(F.lit(1)).alias("forecast_services")))
    else:
        parts.append(spark.range(1).select(F.lit(0).cast("long").alias("forecast_services")))
    one = reduce(lambda a, b: a.crossJoin(b), parts)
    return one.select(F.lit(provider).alias("provider"), "total_records", "normalized_records",
                      "forecast_services", F.lit(llm_enabled).alias("llm_enabled"))


# ---------------------------------------------------------------- F10
def waste_estimates(features: DataFrame, svc_stats: DataFrame) -> DataFrame:
    """Per resource: flat (service mean daily x 30), lifespan-adjusted (resource's mean daily
    cost x min(days, 30)) and the service's runaway projection
    max(last + (last-first)/days*30 - first*30, 0) (days <= 0 -> 0)."""
    s = svc_stats.select(*SERVICE_KEYS, "avg_daily_cost", "first_cost", "last_cost", "days")
    j = join_back(features.select(*RESOURCE_KEYS, "days_active", "cost_sum"), s, SERVICE_KEYS, "left")
    days = F.col("days")
    growth = (F.col("last_cost") - F.col("first_cost")) / days
    projected = F.col("last_cost") + growth * 30
    runaway = F.when(days <= 0, F.lit(0.0)).otherwise(
        money(F.greatest(projected - F.col("first_cost") * 30, F.lit(0.0))))
    resource_daily = F.col("cost_sum") / F.col("days_active")
    return j.select(
        *RESOURCE_KEYS, "days_active",
        money(F.col("avg_daily_cost") * 30).alias("flat_monthly_waste"),
        money(resource_daily * F.least(F.col("days_active"), F.lit(30))).alias("lifespan_waste"),
        runaway.alias("runaway_projected_waste"),
    )
