"""Feature operators (D1–D7): daily series, resource aggregates, windows, statistics.

Shapes that matter at scale:
* every per-service window runs on the *daily* table (one row per service and day),
  never on raw rows, so no window partition grows with the input;
* the per-resource features come from ONE ``groupBy(provider, service, resource_id)``
  (partial aggregation; ``count(distinct date)`` shares the same exchange);
* ranks over resources use ``ranking.value_ranks`` (range slices), not a window that
  would put a whole service in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costsieve import schema as S
from costsieve.functions import money, py_round
from costsieve.functions.numeric import clamp
from costsieve.operators.ranking import average_rank_pct

SERVICE_KEYS = ["provider", "service"]
RESOURCE_KEYS = ["provider", "service", "resource_id"]


def owner_columns(df: DataFrame) -> list[str]:
    """Columns whose lower-cased name contains owner / project / environment."""
    return [c for c in df.columns if any(k in c.lower() for k in S.OWNER_KEYWORDS)]


# ---------------------------------------------------------------- D1
def daily_cost(norm: DataFrame, with_owner_flag: bool = False) -> DataFrame:
    """(date, provider, service, daily_cost[, owned]).

    ``owned`` (optional) says whether any row of that service-day carries an owner /
    project / environment value; it rides on the same aggregation for free and spares
    the always-on detector another scan of the rows.
    """
    aggs = [F.sum("cost").alias("daily_cost")]
    if with_owner_flag:
        owners = owner_columns(norm)
        any_owner = F.lit(False)
        for c in owners:
            any_owner = any_owner | F.col(f"`{c}`").isNotNull()
        aggs.append(F.bool_or(any_owner).alias("owned"))
    return norm.groupBy("date", "provider", "service").agg(*aggs)


# ---------------------------------------------------------------- resource-day slots (one pass)
def resource_day_slots(norm: DataFrame) -> DataFrame:
    """The ONE aggregation over billing rows: one row per
    (resource_id, provider, service, date, slot_region), null / "" resource ids included
    as their own groups, null / "" region as "unknown".

    Everything else derives from this table, which is far smaller than the rows (line
    items are hourly or finer): daily costs (D1), resource features (D3/D4/E6), and the
    orphaned-storage, snapshot and untagged detectors (first row = smallest ``seq``).
    """
    from costsieve.functions import has_text

    owners = owner_columns(norm)
    usage = F.col("usage") if "usage" in norm.columns else F.lit(None).cast("double")
    any_owner = F.lit(False)     # E4: any owner-like value at all (not null)
    row_owned = F.lit(False)     # E8: an owner-like value that is not blank/unknown/none/nan
    for c in owners:
        v = F.col(f"`{c}`").cast("string")
        any_owner = any_owner | F.col(f"`{c}`").isNotNull()
        row_owned = row_owned | (has_text(v) & ~F.lower(v).isin(*S.UNTAGGED_EMPTY_VALUES))
    region = F.when(has_text("region"), F.col("region")).otherwise(F.lit("unknown"))
    # every buffer is fixed-width (long / double / boolean), so this stays a hash aggregate
    aggs = [
        F.min("seq").alias("first_seq"),
        F.sum("cost").alias("cost"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(usage.isNotNull(), F.col("cost"))).alias("usage_cost_sum"),
        F.sum(usage).alias("usage_sum"),
        F.count(usage).alias("usage_rows"),
        F.bool_or(any_owner).alias("owned"),
        # first row's flag, packed with its seq into one long (ties on seq: owned first)
        F.min(F.col("seq") * 2 + F.when(row_owned, 0).otherwise(1)).alias("_first_key"),
    ]
    out = norm.withColumn("slot_region", region).groupBy(
        "resource_id", "provider", "service", "date", "slot_region").agg(*aggs)
    return out.withColumn("first_row_owned", F.col("_first_key") % 2 == 0).drop("_first_key")


def daily_from_slots(slots: DataFrame) -> DataFrame:
    """D1 from the slots table: (date, provider, service, daily_cost, owned)."""
    return slots.groupBy("date", "provider", "service").agg(
        F.sum("cost").alias("daily_cost"), F.bool_or("owned").alias("owned"))


def resource_features_from_slots(slots: DataFrame) -> DataFrame:
    """``resource_features`` computed from the slots table instead of the rows."""
    g = slots.where(F.col("resource_id").isNotNull()).groupBy(*RESOURCE_KEYS).agg(
        F.countDistinct("date").alias("days_active"),
        F.sum("cost").alias("cost_sum"),
        F.sum("rows").alias("rows"),
        F.sum("usage_cost_sum").alias("usage_cost_sum"),
        F.sum("usage_sum").alias("usage_sum"),
        F.sum("usage_rows").alias("usage_rows"),
    )
    return _resource_columns(g)


# ---------------------------------------------------------------- D5
def cost_zscore(daily: DataFrame) -> DataFrame:
    """Adds rolling_mean / rolling_std of the previous 7 days (at least 3) and z_score.

    ``z = (x - mean) / (std + 0.01)``; null while fewer than 3 previous rows exist.
    The window is partitioned by service over the daily table, so each partition holds
    one row per day.
    """
    w = Window.partitionBy(*SERVICE_KEYS).orderBy("date").rowsBetween(-S.ZSCORE_WINDOW, -1)
    enough = F.count("daily_cost").over(w) >= S.ZSCORE_MIN_PERIODS
    mean = F.when(enough, F.avg("daily_cost").over(w))
    std = F.when(enough, F.stddev_samp("daily_cost").over(w))
    out = daily.select("*", mean.alias("rolling_mean"), std.alias("rolling_std"))
    return out.withColumn(
        "z_score", (F.col("daily_cost") - F.col("rolling_mean")) / (F.col("rolling_std") + F.lit(S.ZSCORE_EPSILON))
    )


# ---------------------------------------------------------------- per-service summary of the daily table
def service_stats(daily_z: DataFrame) -> DataFrame:
    """One row per (provider, service) with everything the detectors read from D1/D5.

    avg_daily_cost, days (rows = distinct dates), first/last daily cost, the last row's
    z_score and rolling_mean.
    """
    has_z = "z_score" in daily_z.columns
    last = F.struct(
        F.col("daily_cost").alias("cost"),
        (F.col("z_score") if has_z else F.lit(None).cast("double")).alias("z"),
        (F.col("rolling_mean") if has_z else F.lit(None).cast("double")).alias("mean"),
    )
    return daily_z.groupBy(*SERVICE_KEYS).agg(
        F.avg("daily_cost").alias("avg_daily_cost"),
        F.count(F.lit(1)).alias("days"),
        F.countDistinct("date").alias("days_present"),
        F.min_by("daily_cost", "date").alias("first_cost"),
        F.max_by(last, "date").alias("_last"),
        F.sum("daily_cost").alias("total_cost"),
        (F.bool_or("owned") if "owned" in daily_z.columns else F.lit(None).cast("boolean")).alias("owned"),
    ).select(
        *SERVICE_KEYS, "avg_daily_cost", "days", "days_present", "first_cost", "total_cost", "owned",
        F.col("_last.cost").alias("last_cost"),
        F.col("_last.z").alias("last_z"),
        F.col("_last.mean").alias("last_rolling_mean"),
    )


# ---------------------------------------------------------------- D2
def cost_trend(daily: DataFrame) -> DataFrame:
    """INCREASING / DECREASING / FLAT from the first vs last day's cost; one day -> FLAT."""
    g = daily.groupBy(*SERVICE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("daily_cost", "date").alias("first_cost"),
        F.max_by("daily_cost", "date").alias("last_cost"),
    )
    trend = (
        F.when(F.col("n") < 2, "FLAT")
        .when(F.col("last_cost") > F.col("first_cost"), "INCREASING")
        .when(F.col("last_cost") < F.col("first_cost"), "DECREASING")
        .otherwise("FLAT")
    )
    return g.select(*SERVICE_KEYS, trend.alias("trend"))


# ---------------------------------------------------------------- D3 + D4 (+ per-row mean for E6)
def resource_features(norm: DataFrame) -> DataFrame:
    """One aggregate per (provider, service, resource_id), null resource ids dropped.

    days_active      distinct dates (D3)
    usage_to_cost_ratio  sum(usage)/sum(cost) over rows with usage; null when that cost
                     sum is 0 or no row has usage (D4)
    has_usage        whether D4 has a row for the resource at all
    cost_sum, rows   for the per-row mean cost (E6) and cost percentiles (D7)
    """
    has_usage_col = "usage" in norm.columns
    usage = F.col("usage") if has_usage_col else F.lit(None).cast("double")
    with_usage = usage.isNotNull()
    g = norm.where(F.col("resource_id").isNotNull()).groupBy(*RESOURCE_KEYS).agg(
        F.countDistinct("date").alias("days_active"),
        F.sum("cost").alias("cost_sum"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(with_usage, F.col("cost"))).alias("usage_cost_sum"),
        F.sum(usage).alias("usage_sum"),
        F.count(usage).alias("usage_rows"),
    )
    return _resource_columns(g)


def _resource_columns(g: DataFrame) -> DataFrame:
    ratio = F.when(
        (F.col("usage_rows") > 0) & (F.col("usage_cost_sum") != 0),
        F.col("usage_sum") / F.col("usage_cost_sum"),
    )
    return g.select(
        *RESOURCE_KEYS, F.col("days_active").cast("long").alias("days_active"),
        ratio.alias("usage_to_cost_ratio"), (F.col("usage_rows") > 0).alias("has_usage"),
        "cost_sum", F.col("rows").cast("long").alias("rows"),
        (F.col("cost_sum") / F.col("rows")).alias("mean_row_cost"),
    )


def resource_lifespan(features: DataFrame) -> DataFrame:
    return features.select(*RESOURCE_KEYS, "days_active")


def usage_cost_ratio(features: DataFrame) -> DataFrame:
    return features.where("has_usage").select(*RESOURCE_KEYS, "usage_to_cost_ratio")


# ---------------------------------------------------------------- D6
def forecast_30d(daily: DataFrame) -> DataFrame:
    """Linear 30-day forecast per service (least squares on x = 0..n-1 over positive days).

    Skips services with total cost < 0.01, fewer than 3 positive days, or a population
    coefficient of variation above 1. Projection capped at 3x the last-30-day actual,
    trend clamped to +/-150 %.
    """
    totals = daily.groupBy(*SERVICE_KEYS).agg(F.sum("daily_cost").alias("_total"))
    pos = daily.where(F.col("daily_cost") > 0)
    w = Window.partitionBy(*SERVICE_KEYS).orderBy("date")
    w_desc = Window.partitionBy(*SERVICE_KEYS).orderBy(F.col("date").desc())
    pos = pos.select(
        *SERVICE_KEYS, "daily_cost",
        (F.row_number().over(w) - 1).cast("double").alias("x"),
        F.row_number().over(w_desc).alias("_from_end"),
    )
    y, x = F.col("daily_cost"), F.col("x")
    fit = pos.groupBy(*SERVICE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("std"),
        F.avg(F.when(F.col("_from_end") <= 30, y)).alias("last_mean"),
    )
    fit = fit.join(totals, SERVICE_KEYS, "inner").where(
        (F.col("_total") >= 0.01) & (F.col("n") >= 3)
        & ~((F.col("mean") > 0) & (F.col("std") / F.col("mean") > 1.0))
    )
    projected = F.col("intercept") + F.col("slope") * (F.col("n") + F.lit(30))
    projected = F.when(projected < 0, F.col("mean")).otherwise(projected)
    actual = money(F.col("last_mean") * 30)
    baseline = F.greatest(F.col("last_30d_actual"), F.lit(0.01))
    out = fit.select(
        *SERVICE_KEYS,
        money(projected * 30).alias("_monthly"),
        actual.alias("last_30d_actual"),
    )
    out = out.select(
        *SERVICE_KEYS, "last_30d_actual",
        money(F.least(F.col("_monthly"), baseline * 3)).alias("projected_monthly_cost"),
    )
    raw_trend = (F.col("projected_monthly_cost") - F.col("last_30d_actual")) / baseline * 100
    return out.select(
        *SERVICE_KEYS, "projected_monthly_cost", "last_30d_actual",
        money(clamp(raw_trend, -150.0, 150.0), 1).alias("trend_pct"),
    )


# ---------------------------------------------------------------- D7
def cost_percentiles(norm_or_features: DataFrame, materialized: bool = False) -> DataFrame:
    """Percentile (average rank, 0–100, 1 decimal) of each resource's total cost in its service.

    Accepts the normalized rows or ``resource_features`` (uses ``cost_sum``).
    """
    if "cost_sum" in norm_or_features.columns:
        totals = norm_or_features.select(*RESOURCE_KEYS, F.col("cost_sum").alias("cost"))
    else:
        totals = (
            norm_or_features.where(F.col("resource_id").isNotNull())
            .groupBy(*RESOURCE_KEYS).agg(F.sum("cost").alias("cost"))
        )
    ranked = average_rank_pct(totals, SERVICE_KEYS, "cost", "pct", materialized=materialized)
    return ranked.select(*RESOURCE_KEYS, "cost", py_round(F.col("pct") * 100, 1).alias("percentile"))
