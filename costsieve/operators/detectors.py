"""The ten waste detectors (E1–E10). Each returns LEAK rows plus evidence columns.

Inputs are the shared, already-aggregated frames (``resource_features``,
``service_stats``) or the normalized rows; nothing iterates rows in Python.
Joins go against aggregates (one row per service, per slot or per resource), so the
large side is never duplicated; AQE turns the small sides into broadcasts at runtime
from their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve import schema as S
from costsieve.functions import (
    fmt_fixed,
    fmt_grouped,
    has_text,
    is_block_storage,
    is_compute,
    is_snapshot,
    money,
    py_round,
    service_category,
)
from costsieve.operators.features import RESOURCE_KEYS, SERVICE_KEYS
from costsieve.operators.firsts import code_of, first_key, seq_of, value_codes
from costsieve.operators.ranking import join_back, kth_smallest
from costsieve.session import reliable_checkpoint

# ---- fixed values: reason texts (the scorer reads them, so they are semantics) ----
ORPHANED_REASON = (
    "Storage resource active in regions/dates where no compute was running — likely detached or abandoned"
)
SNAPSHOT_REASON = "Snapshot or backup generating cost with no active parent resource"
UNTAGGED_REASON = "Resource has no ownership tags (owner / project / environment missing)"
ZOMBIE_REASON = ("Active ", " days with usage-to-cost ratio of ", " (below service p25 threshold ", ")")
IDLE_REASON = ("Low usage detected over ", " days")
SPIKE_REASON = ("Cost spike: $", "/day is ", " stddevs above ")
SPIKE_BASELINE = ("7-day baseline of $", "recent baseline")
GROWTH_REASON = ("Daily cost increased from $", " to $", " over ", " days (+", "%)")
ALWAYS_ON_REASON = ("Always-on service costing $", "/day with no ownership metadata")
IDLE_DB_REASON = ("Database active ", " days with minimal usage (ratio ", ")")
SAVINGS_REASON = ("Unused savings plan commitment costing $", " in this billing period")
UNUSED_RI_REASON = ("Unused reserved capacity costing $", " (", ": $", ", ", ")")
UNUSED_RI_PLAIN_REASON = ("Unused reserved instance capacity costing $", " in this billing period")
SAVINGS_ITEM_TYPES = ["SavingsPlanNegation", "SavingsPlanRecurringFee"]
# ---- end of fixed values ----


def _text(pieces: tuple[str, ...], *values: Column) -> Column:
    """The pieces of a reason text with values between them."""
    parts = [F.lit(pieces[0])]
    for i, value in enumerate(values, 1):
        parts += [value, *([F.lit(pieces[i])] if i < len(pieces) else [])]
    return F.concat(*parts)


def _leak_cols(leak_type: str, reason: Column, resource_id: Column | None = None,
               z_score: Column | None = None, exact_waste: Column | None = None,
               order_num: Column | None = None, order_seq: Column | None = None) -> list[Column]:
    return [
        F.lit(leak_type).alias("leak_type"),
        F.col("provider"),
        F.col("service"),
        (resource_id if resource_id is not None else F.lit(None).cast("string")).alias("resource_id"),
        reason.alias("reason"),
        (z_score if z_score is not None else F.lit(None).cast("double")).alias("z_score"),
        (exact_waste if exact_waste is not None else F.lit(None).cast("double")).alias("exact_waste"),
        F.lit(S.DETECTOR_RANK[leak_type]).cast("int").alias("detector_rank"),
        (order_num if order_num is not None else F.lit(None).cast("double")).alias("order_num"),
        (order_seq if order_seq is not None else F.lit(None).cast("long")).alias("order_seq"),
    ]


def _fallback_threshold(provider: Column) -> Column:
    expr = F.lit(S.ZOMBIE_FALLBACK_OTHER)
    for prov, value in reversed(list(S.ZOMBIE_FALLBACK_THRESHOLD.items())):
        expr = F.when(provider == prov, F.lit(value)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- E1
def detect_zombie(features: DataFrame, use_percentiles: bool = True, materialized: bool = False) -> DataFrame:
    """ZOMBIE_RESOURCE: days_active >= 14 and ratio < the service's p25 ratio.

    p25 is the nearest-rank value ``sorted(ratios)[max(0, int(n*0.25) - 1)]`` over the
    service's non-null ratios when n >= 4 (so n = 4..7 picks the minimum and can never
    be undercut); otherwise AWS 0.05, AZURE 0.10, other 3.0. Null ratios are ignored
    (the reference would drop the whole detector on one).
    """
    # the thresholds and the candidates must see bit-identical ratios: materialise them
    # once unless the caller's features already are (float sums differ per evaluation)
    ratios = features.where(F.col("usage_to_cost_ratio").isNotNull()).select(
        *RESOURCE_KEYS, "days_active", "usage_to_cost_ratio")
    if not materialized:
        ratios = reliable_checkpoint(ratios)
    fallback = _fallback_threshold(F.col("provider"))
    cand = ratios.where(F.col("days_active") >= S.ZOMBIE_MIN_DAYS)
    if use_percentiles:
        k_of_n = lambda n: F.greatest(F.lit(0), F.floor(n * F.lit(0.25)).cast("long") - 1)
        p25 = kth_smallest(
            ratios.select(*SERVICE_KEYS, F.col("usage_to_cost_ratio").alias("p25")), SERVICE_KEYS, "p25", k_of_n
        ).where(F.col("n") >= 4).select(*SERVICE_KEYS, "p25")
        cand = join_back(cand, p25, SERVICE_KEYS, "left")
        threshold = F.coalesce(F.col("p25"), fallback)
    else:
        threshold = fallback
    cand = cand.withColumn("threshold", threshold).where(F.col("usage_to_cost_ratio") < F.col("threshold"))
    reason = _text(ZOMBIE_REASON, F.col("days_active").cast("string"), fmt_fixed("usage_to_cost_ratio", 4),
                   fmt_fixed("threshold", 4))
    return cand.select(
        *_leak_cols(S.ZOMBIE, reason, F.col("resource_id")),
        "days_active", "usage_to_cost_ratio", "threshold",
    )


# ---------------------------------------------------------------- E2
def detect_idle(features: DataFrame, svc_stats: DataFrame, zombie_ids: DataFrame | None) -> DataFrame:
    """IDLE_RESOURCE: compute, days >= 3, ratio <= 5, service mean daily cost >= 1, not a zombie id."""
    cand = features.where(
        (service_category("service") == "compute")
        & (F.col("days_active") >= S.IDLE_MIN_DAYS_ACTIVE)
        & F.col("usage_to_cost_ratio").isNotNull()
        & (F.col("usage_to_cost_ratio") <= S.IDLE_USAGE_RATIO_THRESHOLD)
    )
    cand = join_back(cand, svc_stats.select(*SERVICE_KEYS, "avg_daily_cost"), SERVICE_KEYS, "left")
    cand = cand.where(F.coalesce(F.col("avg_daily_cost"), F.lit(0.0)) >= S.IDLE_MIN_DAILY_COST)
    if zombie_ids is not None:
        cand = cand.join(zombie_ids.select("resource_id").distinct(), "resource_id", "left_anti")
    reason = _text(IDLE_REASON, F.col("days_active").cast("string"))
    return cand.select(
        *_leak_cols(S.IDLE, reason, F.col("resource_id")),
        "days_active", "usage_to_cost_ratio", "avg_daily_cost",
    )


# ---------------------------------------------------------------- E3
def detect_runaway(svc_stats: DataFrame, features: DataFrame | None) -> DataFrame:
    """RUNAWAY_COST per service: >= 3 days, mean >= 2, mean resource ratio not > 10;
    last-day z >= 2.5 (z path), else growth last vs first >= 30 % (growth path)."""
    s = svc_stats.where((F.col("days") >= S.RUNAWAY_MIN_DAYS) & (F.col("avg_daily_cost") >= S.RUNAWAY_MIN_DAILY_COST))
    if features is not None:
        ratio_mean = features.where("has_usage").groupBy(*SERVICE_KEYS).agg(
            F.avg("usage_to_cost_ratio").alias("mean_usage_ratio"))
        s = join_back(s, ratio_mean, SERVICE_KEYS, "left")
        s = s.where(~F.coalesce(F.col("mean_usage_ratio") > S.RUNAWAY_MAX_USAGE_RATIO, F.lit(False)))
    z_hit = F.col("last_z").isNotNull() & (F.col("last_z") >= S.RUNAWAY_ZSCORE_THRESHOLD)
    growth = (F.col("last_cost") - F.col("first_cost")) / F.greatest(F.col("first_cost"), F.lit(0.01)) * 100
    s = s.withColumn("growth_pct", growth).withColumn("z_path", z_hit)
    s = s.where(F.col("z_path") | (F.col("growth_pct") >= S.RUNAWAY_COST_GROWTH_PERCENT))
    baseline = F.when(
        F.col("last_rolling_mean").isNotNull(), F.concat(F.lit(SPIKE_BASELINE[0]), fmt_fixed("last_rolling_mean", 2)),
    ).otherwise(F.lit(SPIKE_BASELINE[1]))
    z_reason = _text(SPIKE_REASON, fmt_fixed("last_cost", 2), fmt_fixed("last_z", 1), baseline)
    g_reason = _text(GROWTH_REASON, fmt_fixed("first_cost", 2), fmt_fixed("last_cost", 2), F.col("days").cast("string"),
                     fmt_fixed("growth_pct", 0))
    reason = F.when(F.col("z_path"), z_reason).otherwise(g_reason)
    z_out = F.when(F.col("z_path"), py_round("last_z", 2))
    return s.select(
        *_leak_cols(S.RUNAWAY, reason, z_score=z_out),
        F.when(F.col("z_path"), "z").otherwise("growth").alias("path"),
        "days", "first_cost", "last_cost", "avg_daily_cost",
    )


# ---------------------------------------------------------------- E4
def detect_always_on(daily: DataFrame, svc_stats: DataFrame) -> DataFrame:
    """ALWAYS_ON_HIGH_COST: compute/database, mean daily >= 50, present on >= 90 % of all
    billing days, and no owner/project/environment value on any row of the service
    (``owned`` flag carried by the daily aggregate)."""
    total_days = daily.agg(F.countDistinct("date").alias("total_days"))  # one row
    s = svc_stats.where(
        service_category("service").isin("compute", "database")
        & (F.col("avg_daily_cost") >= S.ALWAYS_ON_MIN_DAILY_COST)
    ).crossJoin(F.broadcast(total_days))
    s = s.where(F.col("days_present") / F.greatest(F.col("total_days"), F.lit(1)) >= S.ALWAYS_ON_PRESENCE_RATIO)
    s = s.where(~F.coalesce(F.col("owned"), F.lit(False)))
    reason = _text(ALWAYS_ON_REASON, fmt_fixed("avg_daily_cost", 2))
    return s.select(*_leak_cols(S.ALWAYS_ON, reason), "avg_daily_cost", "days_present", "total_days")


def service_codes(services: DataFrame, made: list[str] | None = None) -> DataFrame:
    """The dictionary of providers and services that E5, E7 and E8 share (few rows)."""
    return value_codes(services, SERVICE_KEYS, "_code", made)


def _first_by_resource(slots: DataFrame, codes: DataFrame, flag: str | None = None, *aggs: Column) -> DataFrame:
    """Provider/service (and the boolean ``flag``) of each resource id's first row, with further
    aggregates over its slots: one hash aggregate by resource, without sorting slots.

    "First" is the smallest ``first_seq``; equal ``seq`` values (inputs without a unique row order)
    are broken by the values themselves, so the pick is the same every run.
    """
    code = F.col("_code") * 2 + (F.coalesce(F.col(flag), F.lit(False)).cast("int") if flag else F.lit(0))
    first = _with_codes(slots, codes).groupBy("resource_id").agg(F.min(first_key(F.col("first_seq"), code)).alias("_first"), *aggs)
    more = [c for c in first.columns if c not in ("resource_id", "_first")]
    plain = first.select("resource_id", seq_of(F.col("_first")).alias("first_seq"), F.shiftright(code_of(F.col("_first")), 1).alias("_code"),
                         (code_of(F.col("_first")) % 2 == 1).alias(flag or "_flag"), *more)
    return plain.join(codes, "_code").select("resource_id", "first_seq", *SERVICE_KEYS, *([flag] if flag else []), *more)


def _with_codes(slots: DataFrame, codes: DataFrame) -> DataFrame:
    """Null services and providers are values of their own."""
    named = codes.toDF(*[f"_{c}" for c in SERVICE_KEYS], "_code")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SERVICE_KEYS]
    return slots.join(named, same[0] & same[1]).drop(*[f"_{c}" for c in SERVICE_KEYS])


# ---------------------------------------------------------------- E5
def detect_orphaned_storage(slots: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """ORPHANED_STORAGE: block-storage resource none of whose (provider, date, region)
    slots had any compute. Null/"" region is "unknown"; a row that is compute never
    counts as storage. Keyed by resource id alone, provider/service of its first row.

    ``slots`` is ``features.resource_day_slots`` (one row per resource, day, region). Storage
    slots meet the distinct compute slots once, then one aggregate by resource says whether
    any of its slots was covered.
    """
    tagged = slots.where(has_text("resource_id")).select(
        "resource_id", "provider", "service", "date", "slot_region", "first_seq",
        is_compute("service", "provider").alias("_compute"),
        is_block_storage("service", "provider").alias("_block"),
    )
    slot = ["provider", "date", "slot_region"]
    compute_slots = tagged.where("_compute").select(*slot).distinct().withColumn("_covered", F.lit(True))
    storage = tagged.where(~F.col("_compute") & F.col("_block")).join(compute_slots, slot, "left")
    found = _first_by_resource(storage, codes or service_codes(slots), None, F.coalesce(F.bool_or("_covered"), F.lit(False)).alias("_covered"))
    return found.where(~F.col("_covered")).select(
        *_leak_cols(S.ORPHANED, F.lit(ORPHANED_REASON), F.col("resource_id"), order_seq=F.col("first_seq")))


# ---------------------------------------------------------------- E6
def detect_idle_database(features: DataFrame) -> DataFrame:
    """IDLE_DATABASE: database, days >= 7, ratio <= 0.2, mean cost *per row* >= 10.

    "Daily cost" is the mean per billing row, as in the reference; with several rows a
    day it understates the daily cost. Carries waste = round(mean * 30, 2).
    """
    cand = features.where(
        (service_category("service") == "database")
        & (F.col("days_active") >= S.IDLE_DB_MIN_DAYS)
        & F.col("usage_to_cost_ratio").isNotNull()
        & (F.col("usage_to_cost_ratio") <= S.IDLE_DB_USAGE_RATIO_THRESHOLD)
        & (F.col("mean_row_cost") >= S.IDLE_DB_MIN_DAILY_COST)
    )
    reason = _text(IDLE_DB_REASON, F.col("days_active").cast("string"), fmt_fixed("usage_to_cost_ratio", 4))
    return cand.select(
        *_leak_cols(S.IDLE_DB, reason, F.col("resource_id"),
                    exact_waste=money(F.col("mean_row_cost") * 30)),
        "days_active", "usage_to_cost_ratio", "mean_row_cost",
    )


# ---------------------------------------------------------------- E7
def detect_snapshot_sprawl(slots: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """SNAPSHOT_SPRAWL: snapshot/backup resource id that never appears on a compute or
    database row (any provider or service). ``slots`` as for E5."""
    slots = slots.where(has_text("resource_id"))
    active = slots.where(service_category("service").isin("compute", "database")).select("resource_id").distinct()
    snaps = _first_by_resource(slots.where(is_snapshot("service", "provider")), codes or service_codes(slots))
    out = snaps.join(active, "resource_id", "left_anti")
    return out.select(*_leak_cols(S.SNAPSHOT, F.lit(SNAPSHOT_REASON), F.col("resource_id"),
                                  order_seq=F.col("first_seq")))


# ---------------------------------------------------------------- E8
def untagged_candidates(slots: DataFrame, svc_stats: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """All untagged resources before the top-N cap, judged on each resource's first row.

    Skipped when both the resource's total cost (all its rows) and its first row's
    service total are below 0.01; untagged when every owner-like value of the first row
    is null, "", unknown, none or nan (any case) — ``first_row_owned`` in the slots.
    """
    slots = slots.where(has_text("resource_id"))
    cand = _first_by_resource(slots, codes or service_codes(svc_stats), "first_row_owned", F.sum("cost").alias("resource_cost"))
    cand = join_back(cand, svc_stats.select(*SERVICE_KEYS, F.col("total_cost").alias("service_cost")),
                     SERVICE_KEYS, "left")
    rc = F.coalesce(F.col("resource_cost"), F.lit(0.0))
    sc = F.coalesce(F.col("service_cost"), F.lit(0.0))
    cand = cand.where(~((rc < 0.01) & (sc < 0.01)))
    return cand.where(~F.coalesce(F.col("first_row_owned"), F.lit(False))).withColumn(
        "resource_cost", rc).drop("first_row_owned")


def detect_untagged(slots: DataFrame, svc_stats: DataFrame, top_n: int | None = S.UNTAGGED_TOP_N,
                    codes: DataFrame | None = None) -> DataFrame:
    """UNTAGGED_RESOURCE: the ``top_n`` costliest untagged resources (ties: first seen)."""
    cand = untagged_candidates(slots, svc_stats, codes)
    if top_n is not None:
        cand = cand.orderBy(F.col("resource_cost").desc(), F.col("first_seq").asc()).limit(int(top_n))
    return cand.select(
        *_leak_cols(S.UNTAGGED, F.lit(UNTAGGED_REASON), F.col("resource_id"),
                    order_num=-F.col("resource_cost"), order_seq=F.col("first_seq")),
        "resource_cost",
    )


# ---------------------------------------------------------------- E9, E10
def _num(c: str) -> Column:
    return F.col(c).try_cast("double")


def commitment_totals(raw: DataFrame) -> DataFrame:
    """One row per service code of the raw CUR (underscore names): what E9 and E10 and the raw
    row count need, from one scan. A missing column leaves its totals at 0 rows."""
    have = set(raw.columns)
    service = F.col("product_servicecode").cast("string") if "product_servicecode" in have else F.lit(None).cast("string")
    none = F.lit(False)
    plan = F.col("line_item_line_item_type").isin(*SAVINGS_ITEM_TYPES) if SAVINGS_COLUMNS <= have else none
    unused = F.coalesce(_num("reservation_unused_quantity"), F.lit(0.0)) > 0 if UNUSED_COLUMNS <= have else none
    cost = _num("line_item_unblended_cost") if "line_item_unblended_cost" in have else F.lit(0.0)
    fee = _num("reservation_unused_recurring_fee") if "reservation_unused_recurring_fee" in have else F.lit(0.0)
    return raw.groupBy(service.alias("code")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(plan).alias("plan_rows"), F.coalesce(F.sum(F.when(plan, cost)), F.lit(0.0)).alias("plan_cost"),
        F.count_if(unused).alias("unused_rows"), F.coalesce(F.sum(F.when(unused, fee)), F.lit(0.0)).alias("unused_fee"),
    )


SAVINGS_COLUMNS = {"line_item_line_item_type", "line_item_unblended_cost"}
UNUSED_COLUMNS = {"reservation_unused_quantity", "reservation_unused_recurring_fee"}


def savings_plan_leak(totals: DataFrame) -> DataFrame:
    """E9 from ``commitment_totals``."""
    agg = totals.agg(F.coalesce(F.sum("plan_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("plan_cost"), F.lit(0.0)).alias("total"))
    agg = agg.where((F.col("n") > 0) & (F.col("total") >= S.RI_MIN_WASTE_USD)).select(
        "total", F.lit("AWS").alias("provider"), F.lit("Savings Plans").alias("service"))
    reason = _text(SAVINGS_REASON, fmt_grouped("total", 2))
    return agg.select(*_leak_cols(S.RI_SAVINGS, reason, exact_waste=py_round("total", 2)), "total")


def unused_reservation_leak(totals: DataFrame, by_service: bool = True) -> DataFrame:
    """E10 from ``commitment_totals``. The three largest services are cut out before anything is
    gathered, so the reason is made of three rows."""
    total = totals.agg(F.coalesce(F.sum("unused_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("unused_fee"), F.lit(0.0)).alias("total"))
    total = total.where((F.col("n") > 0) & (F.col("total") >= S.RI_MIN_WASTE_USD))
    if by_service:
        top = (totals.where(F.col("code").isNotNull() & (F.col("unused_rows") > 0))
               .orderBy(F.col("unused_fee").desc(), "code").limit(3))
        named = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("unused_fee")).alias("k"), "code", "unused_fee"))).alias("top"))
        detail = F.array_join(
            F.transform("top", lambda t: F.concat(t["code"], F.lit(UNUSED_RI_REASON[2]), fmt_grouped(t["unused_fee"], 2))), UNUSED_RI_REASON[3])
        total = total.crossJoin(named.select(detail.alias("detail")))  # one row beside one row
        reason = F.concat(F.lit(UNUSED_RI_REASON[0]), fmt_grouped("total", 2), F.lit(UNUSED_RI_REASON[1]), F.col("detail"),
                          F.lit(UNUSED_RI_REASON[4]))
    else:
        reason = _text(UNUSED_RI_PLAIN_REASON, fmt_grouped("total", 2))
    total = total.select("*", F.lit("AWS").alias("provider"), F.lit("Reserved Instances").alias("service"))
    return total.select(*_leak_cols(S.RI_UNUSED, reason, exact_waste=py_round("total", 2)), "total")


def detect_savings_plan(raw: DataFrame) -> DataFrame:
    """RI_SAVINGS_PLAN_WASTE: unblended cost of SavingsPlanNegation + SavingsPlanRecurringFee
    rows (raw CUR, underscore names) totals >= 10. Carries the total (rounded to cents)."""
    if not SAVINGS_COLUMNS <= set(raw.columns):
        return _empty_leaks(raw)
    return savings_plan_leak(commitment_totals(raw.where(F.col("line_item_line_item_type").isin(*SAVINGS_ITEM_TYPES)).select(
        *SAVINGS_COLUMNS)))


def detect_unused_reservation(raw: DataFrame) -> DataFrame:
    """RI_UNUSED_RESERVATION: rows with unused quantity > 0 whose unused fee totals >= 10;
    the reason names the top 3 services by fee."""
    if not UNUSED_COLUMNS <= set(raw.columns):
        return _empty_leaks(raw)
    return unused_reservation_leak(commitment_totals(raw), "product_servicecode" in raw.columns)


def _empty_leaks(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], S.LEAK)
