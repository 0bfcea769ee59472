"""Registered queries: a Spark plan per operator and its DuckDB oracle SQL.

Each Spark query takes ``(spark, sf_dir)``, reads the driver tables (whole tables, no
sampling) and returns a DataFrame; the oracle is independent SQL over the same tables.
Computed columns carry the same aliases on both sides; doubles that come out of float
sums are rounded to 6 decimals on both sides (Python rounding rule).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costsieve import schema as S
from costsieve.functions import (
    is_block_storage,
    is_compute,
    is_snapshot,
    is_storage,
    py_round,
    service_category,
)
from costsieve.operators import detectors as E
from costsieve.operators import features as D
from costsieve.operators import scoring as Fs
from costsieve.plans import oracle as O
from costsieve.plans.pipeline import analyze, build_features
from costsieve.sources.tables import billing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return py_round(c, 6)


BASE = [O.BILLING_CTE] + O.pipeline_ctes()


def q(sql: str, ctes: list[str] | None = None) -> str:
    ctes = ctes if ctes is not None else BASE
    return (O.with_ctes(*ctes) + sql) if ctes else sql


# ------------------------------------------------------------------ shared Spark pieces
def _features(spark, sf_dir):
    return build_features(billing(spark, sf_dir))


# single-operator queries build only the aggregate they read (one job, no materialisation);
# the pipeline (``analyze``) materialises all of them once for its ten readers
def _resources(spark, sf_dir):
    return D.resource_features(billing(spark, sf_dir))


def _daily(spark, sf_dir):
    return D.cost_zscore(D.daily_cost(billing(spark, sf_dir), with_owner_flag=True))


def _services(spark, sf_dir):
    return D.service_stats(_daily(spark, sf_dir))


def _analysis(spark, sf_dir):
    return analyze(billing(spark, sf_dir), already_normalized=True)


# ================================================================== D: features
@register("daily_cost", q("select date, provider, service, " + O.pr("daily_cost", 6) + " as daily_cost from daily0"))
def daily_cost_q(spark, sf_dir):
    d = D.daily_cost(billing(spark, sf_dir))
    return d.select("date", "provider", "service", r6("daily_cost").alias("daily_cost"))


@register("cost_zscore", q(
    "select date, provider, service, " + ", ".join(
        f"{O.pr(c, 6)} as {c}" for c in ["daily_cost", "rolling_mean", "rolling_std", "z_score"]) + " from dailyz"))
def cost_zscore_q(spark, sf_dir):
    z = D.cost_zscore(D.daily_cost(billing(spark, sf_dir)))
    return z.select("date", "provider", "service",
                    *[r6(c).alias(c) for c in ["daily_cost", "rolling_mean", "rolling_std", "z_score"]])


@register("cost_trend", q("""select provider, service, case when count(*) < 2 then 'FLAT'
    when arg_max(daily_cost, date) > arg_min(daily_cost, date) then 'INCREASING'
    when arg_max(daily_cost, date) < arg_min(daily_cost, date) then 'DECREASING' else 'FLAT' end as trend
    from daily0 group by provider, service"""))
def cost_trend_q(spark, sf_dir):
    return D.cost_trend(D.daily_cost(billing(spark, sf_dir)))


@register("resource_lifespan", q("select provider, service, resource_id, days_active from resf"))
def resource_lifespan_q(spark, sf_dir):
    return D.resource_lifespan(_resources(spark, sf_dir))


@register("usage_cost_ratio", q(
    "select provider, service, resource_id, " + O.pr("ratio", 6) + " as usage_to_cost_ratio from resf where has_usage"))
def usage_cost_ratio_q(spark, sf_dir):
    r = D.usage_cost_ratio(_resources(spark, sf_dir))
    return r.select("provider", "service", "resource_id", r6("usage_to_cost_ratio").alias("usage_to_cost_ratio"))


FORECAST_SQL = f"""fc0 as (select provider, service, daily_cost, date,
      row_number() over (partition by provider, service order by date) - 1 as x,
      row_number() over (partition by provider, service order by date desc) as from_end
    from daily0 where daily_cost > 0),
  fc1 as (select f.provider, f.service, count(*) as n, regr_slope(daily_cost, x) as slope,
      regr_intercept(daily_cost, x) as intercept, avg(daily_cost) as mean, stddev_pop(daily_cost) as std,
      avg(case when from_end <= 30 then daily_cost end) as last_mean
    from fc0 f group by f.provider, f.service),
  fc2 as (select f.*, {O.money("(case when intercept + slope * (n + 30) < 0 then mean else intercept + slope * (n + 30) end) * 30")} as monthly0,
      {O.money("last_mean * 30")} as last_30d_actual
    from fc1 f join (select provider, service, sum(daily_cost) as total from daily0 group by provider, service) t
      on t.provider = f.provider and t.service = f.service
    where t.total >= 0.01 and n >= 3 and not (mean > 0 and std / mean > 1.0)),
  fc3 as (select provider, service, last_30d_actual,
      {O.money("least(monthly0, greatest(last_30d_actual, 0.01) * 3)")} as projected_monthly_cost from fc2),
  forecast as (select provider, service, projected_monthly_cost, last_30d_actual,
      {O.money("greatest(-150.0, least(150.0, (projected_monthly_cost - last_30d_actual) / greatest(last_30d_actual, 0.01) * 100))", 1)} as trend_pct
    from fc3)"""
FORECAST_CTES = BASE + [FORECAST_SQL]


@register("forecast_30d", q("select * from forecast", FORECAST_CTES))
def forecast_q(spark, sf_dir):
    return D.forecast_30d(D.daily_cost(billing(spark, sf_dir)))


@register("cost_percentiles", q(f"""select provider, service, resource_id, {O.pr('cost_sum', 6)} as cost,
    {O.pr('(rank() over w - 1 + (count(*) over (partition by provider, service, cost_sum) + 1) / 2e0) / (count(*) over (partition by provider, service)) * 100', 1)} as percentile
    from resf window w as (partition by provider, service order by cost_sum)"""))
def cost_percentiles_q(spark, sf_dir):
    p = D.cost_percentiles(_resources(spark, sf_dir))
    return p.select("provider", "service", "resource_id", r6("cost").alias("cost"), "percentile")


@register("service_category", q(f"select distinct provider, service, {O.category()} as category from norm"))
def service_category_q(spark, sf_dir):
    b = billing(spark, sf_dir)
    return b.select("provider", "service", service_category("service").alias("category")).distinct()


@register("service_flags", q(f"""select distinct provider, service, {O.is_compute()} as is_compute,
    {O.is_storage()} as is_storage, {O.is_snapshot()} as is_snapshot, {O.is_block()} as is_block_storage from norm"""))
def service_flags_q(spark, sf_dir):
    b = billing(spark, sf_dir)
    return b.select(
        "provider", "service", is_compute().alias("is_compute"), is_storage().alias("is_storage"),
        is_snapshot().alias("is_snapshot"), is_block_storage().alias("is_block_storage"),
    ).distinct()


# ================================================================== E: detectors
LEAK_OUT = ["leak_type", "provider", "service", "resource_id", "reason"]


def _leak_sql(cte: str, extra: str = "", where: str = "") -> str:
    return q(f"select leak_type, provider, service, resource_id, reason{extra} from leaks "
             f"where leak_type = '{cte}'{where}")


@register("leak_zombie", q(f"""select 'ZOMBIE_RESOURCE' as leak_type, provider, service, resource_id,
    days_active, {O.pr('ratio', 6)} as usage_to_cost_ratio, {O.pr('threshold', 6)} as threshold,
    'Active ' || days_active || ' days with usage-to-cost ratio of ' || {O.ff('ratio', 4)}
      || ' (below service p25 threshold ' || {O.ff('threshold', 4)} || ')' as reason from zombie"""))
def leak_zombie_q(spark, sf_dir):
    z = E.detect_zombie(_resources(spark, sf_dir))
    return z.select(*LEAK_OUT, "days_active", r6("usage_to_cost_ratio").alias("usage_to_cost_ratio"),
                    r6("threshold").alias("threshold"))


@register("leak_idle", q(f"""select 'IDLE_RESOURCE' as leak_type, provider, service, resource_id, days_active,
    {O.pr('ratio', 6)} as usage_to_cost_ratio, {O.pr('avg_daily_cost', 6)} as avg_daily_cost,
    'Low usage detected over ' || days_active || ' days' as reason from idle"""))
def leak_idle_q(spark, sf_dir):
    res = _resources(spark, sf_dir)
    z = E.detect_zombie(res)
    i = E.detect_idle(res, _services(spark, sf_dir), z.select("resource_id"))
    return i.select(*LEAK_OUT, "days_active", r6("usage_to_cost_ratio").alias("usage_to_cost_ratio"),
                    r6("avg_daily_cost").alias("avg_daily_cost"))


@register("leak_runaway", q(f"""select l.leak_type, l.provider, l.service, l.resource_id, l.reason, l.z_score,
    case when r.z_path then 'z' else 'growth' end as path, r.days,
    {O.pr('r.first_cost', 6)} as first_cost, {O.pr('r.last_cost', 6)} as last_cost
    from leaks l join runaway r on r.provider = l.provider and r.service = l.service
    where l.leak_type = 'RUNAWAY_COST'"""))
def leak_runaway_q(spark, sf_dir):
    r = E.detect_runaway(_services(spark, sf_dir), _resources(spark, sf_dir))
    return r.select(*LEAK_OUT, "z_score", "path", "days", r6("first_cost").alias("first_cost"),
                    r6("last_cost").alias("last_cost"))


@register("leak_always_on", q(f"""select 'ALWAYS_ON_HIGH_COST' as leak_type, provider, service,
    null::varchar as resource_id,
    'Always-on service costing $' || {O.ff('avg_daily_cost', 2)} || '/day with no ownership metadata' as reason,
    {O.pr('avg_daily_cost', 6)} as avg_daily_cost, days_present, total_days from always_on"""))
def leak_always_on_q(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    a = E.detect_always_on(daily, D.service_stats(daily))
    return a.select(*LEAK_OUT, r6("avg_daily_cost").alias("avg_daily_cost"), "days_present", "total_days")


@register("leak_orphaned_storage", _leak_sql("ORPHANED_STORAGE", ", order_seq as first_seq"))
def leak_orphaned_q(spark, sf_dir):
    o = E.detect_orphaned_storage(D.resource_day_slots(billing(spark, sf_dir)))
    return o.select(*LEAK_OUT, F.col("order_seq").alias("first_seq"))


@register("leak_idle_database", q(f"""select 'IDLE_DATABASE' as leak_type, provider, service, resource_id,
    'Database active ' || days_active || ' days with minimal usage (ratio ' || {O.ff('ratio', 4)} || ')' as reason,
    days_active, {O.money('mean_row_cost * 30')} as exact_waste, {O.pr('mean_row_cost', 6)} as mean_row_cost
    from idle_db"""))
def leak_idle_db_q(spark, sf_dir):
    i = E.detect_idle_database(_resources(spark, sf_dir))
    return i.select(*LEAK_OUT, "days_active", "exact_waste", r6("mean_row_cost").alias("mean_row_cost"))


@register("leak_snapshot_sprawl", _leak_sql("SNAPSHOT_SPRAWL", ", order_seq as first_seq"))
def leak_snapshot_q(spark, sf_dir):
    s = E.detect_snapshot_sprawl(D.resource_day_slots(billing(spark, sf_dir)))
    return s.select(*LEAK_OUT, F.col("order_seq").alias("first_seq"))


@register("leak_untagged", q(f"""select 'UNTAGGED_RESOURCE' as leak_type, provider, service, resource_id,
    'Resource has no ownership tags (owner / project / environment missing)' as reason,
    {O.pr('resource_cost', 6)} as resource_cost, first_seq from untagged"""))
def leak_untagged_q(spark, sf_dir):
    u = E.detect_untagged(D.resource_day_slots(billing(spark, sf_dir)), _services(spark, sf_dir))
    return u.select(*LEAK_OUT, r6("resource_cost").alias("resource_cost"), F.col("order_seq").alias("first_seq"))


@register("untagged_candidates", q(f"""select resource_id, provider, service, {O.pr('resource_cost', 6)} as resource_cost,
    first_seq from untagged_all"""))
def untagged_candidates_q(spark, sf_dir):
    u = E.untagged_candidates(D.resource_day_slots(billing(spark, sf_dir)), _services(spark, sf_dir))
    return u.select("resource_id", "provider", "service", r6("resource_cost").alias("resource_cost"), "first_seq")


# ================================================================== F: scoring
SCORED_OUT = ["leak_type", "provider", "service", "resource_id", "severity_score", "severity",
              "estimated_monthly_waste", "estimated_annual_waste", "confidence"]
SCORED_SQL_OUT = ", ".join(SCORED_OUT)


@register("dedupe_leaks", q("select leak_type, provider, service, resource_id, detector_rank from dedup"))
def dedupe_q(spark, sf_dir):
    return _analysis(spark, sf_dir).leaks.select("leak_type", "provider", "service", "resource_id", "detector_rank")


@register("score_leaks", q(f"select {SCORED_SQL_OUT}, reason, recommended_action, report_pos from ranked"))
def score_q(spark, sf_dir):
    from costsieve.operators.ranking import global_positions

    s = _analysis(spark, sf_dir).scored
    s = global_positions(s, [F.col("rank_key")], "report_pos")
    return s.select(*SCORED_OUT, "reason", "recommended_action", F.col("report_pos").cast("long").alias("report_pos"))


@register("severity_rollup", q("""select severity, count(*) as leaks, cast(sum(severity_score) as bigint) as score_sum,
    min(severity_score) as min_score, max(severity_score) as max_score from scored group by severity"""))
def severity_rollup_q(spark, sf_dir):
    s = _analysis(spark, sf_dir).scored
    return s.groupBy("severity").agg(
        F.count(F.lit(1)).alias("leaks"), F.sum("severity_score").cast("long").alias("score_sum"),
        F.min("severity_score").alias("min_score"), F.max("severity_score").alias("max_score"))


@register("monthly_waste", q("""select leak_type, provider, service, resource_id, estimated_monthly_waste,
    estimated_annual_waste from scored"""))
def monthly_waste_q(spark, sf_dir):
    s = _analysis(spark, sf_dir).scored
    return s.select("leak_type", "provider", "service", "resource_id", "estimated_monthly_waste",
                    "estimated_annual_waste")


@register("confidence", q("""select leak_type, provider, service, resource_id, days_active, confidence from scored"""))
def confidence_q(spark, sf_dir):
    s = _analysis(spark, sf_dir).scored
    return s.select("leak_type", "provider", "service", "resource_id", "days_active", "confidence")


@register("primary_leaks", q(f"select {SCORED_SQL_OUT}, primary_key, primary_pos from primary_order"))
def primary_q(spark, sf_dir):
    from costsieve.operators.ranking import global_positions

    p = _analysis(spark, sf_dir).primary
    p = global_positions(p, [F.col("first_key")], "primary_pos")
    return p.select(*SCORED_OUT, "primary_key", F.col("primary_pos").cast("long").alias("primary_pos"))


@register("summary", q(f"""select count(*) as total_leaks, cast(count_if(severity = 'HIGH') as bigint) as high,
    cast(count_if(severity = 'MEDIUM') as bigint) as medium, cast(count_if(severity = 'LOW') as bigint) as low,
    {O.money('coalesce(sum(estimated_monthly_waste), 0.0)')} as estimated_monthly_waste_usd,
    {O.money('coalesce(sum(estimated_monthly_waste), 0.0) * 12')} as estimated_annual_waste_usd
    from primary_leaks"""))
def summary_q(spark, sf_dir):
    return _analysis(spark, sf_dir).summary


@register("pipeline_stats", q("""select 'MULTI' as provider, (select count(*) from events) as total_records,
    (select count(*) from norm) as normalized_records, (select count(*) from forecast) as forecast_services,
    false as llm_enabled""", FORECAST_CTES))
def pipeline_stats_q(spark, sf_dir):
    return _analysis(spark, sf_dir).stats


@register("waste_estimates", q(f"""select r.provider, r.service, r.resource_id, r.days_active,
    {O.money('s.avg_daily_cost * 30')} as flat_monthly_waste,
    {O.money('r.cost_sum / r.days_active * least(r.days_active, 30)')} as lifespan_waste,
    case when s.days <= 0 then 0.0 else {O.money('greatest(s.last_cost + (s.last_cost - s.first_cost) / s.days * 30 - s.first_cost * 30, 0.0)')} end
      as runaway_projected_waste
    from resf r left join svc2 s on s.provider = r.provider and s.service = r.service"""))
def waste_estimates_q(spark, sf_dir):
    return Fs.waste_estimates(_resources(spark, sf_dir), _services(spark, sf_dir))


# ================================================================== C: CUR normalization and ingest
from costsieve.operators import cur as C  # noqa: E402
from costsieve.operators import explore as I  # noqa: E402
from costsieve.operators import normalize as N  # noqa: E402
from costsieve.sources.tables import cur  # noqa: E402

_code_case = "case trim(coalesce(product_servicecode, 'Unknown')) " + " ".join(
    f"when '{k}' then '{v}'" for k, v in O.SERVICE_CODE_MAPPING.items()) + " end"
CUR_X = f"""cur_x as (select seq, try_cast(line_item_usage_start_date as date) as date,
    coalesce({_code_case}, coalesce(product_servicecode, 'Unknown')) as service,
    trim(coalesce(line_item_resource_id, '')) as resource_id,
    split_part(coalesce(line_item_usage_type, 'Unknown'), '-', 1) as usage_type,
    coalesce(try_cast(line_item_usage_amount as double), 0.0) as usage,
    coalesce(try_cast(line_item_unblended_cost as double), 0.0) as cost,
    coalesce(product_region, 'Unknown') as region,
    line_item_line_item_type as item_type,
    reservation_unused_quantity, reservation_unused_recurring_fee
  from {{src}} where try_cast(line_item_usage_start_date as date) is not null
    and line_item_line_item_type in ('Usage', 'DiscountedUsage', 'Fee'))"""
CUR_AGG = """cur_agg as (select date, service, resource_id, usage_type,
    round_even(sum(cost) * 1e6, 0) / 1e6 as cost, round_even(sum(usage) * 1e6, 0) / 1e6 as usage,
    (min({'s': seq, 'r': region}) filter (where region is not null)).r as region
  from cur_x group by date, service, resource_id, usage_type)"""
CUR_BASE = [O.CUR_CTE, CUR_X.format(src="cur"), CUR_AGG]


def _ingested(spark, sf_dir):
    return C.cur_ingest(cur(spark, sf_dir))


@register("normalize_aws", q("""select seq, try_cast(line_item_usage_start_date as date) as date, 'AWS' as provider,
    case when product_servicecode = 'Amazon Elastic Block Store' then 'AmazonEBS' else product_servicecode end as service,
    line_item_unblended_cost as cost, line_item_usage_amount as usage,
    line_item_resource_id as resource_id, product_region as region
    from cur where line_item_line_item_type is distinct from 'Tax'""", [O.CUR_CTE]))
def normalize_aws_q(spark, sf_dir):
    n = N.normalize_aws(cur(spark, sf_dir))
    return n.select("seq", "date", "provider", "service", "cost", "usage", "resource_id", "region")


@register("tax_filter", q("""select line_item_line_item_type, count(*) as rows,
    """ + O.pr("sum(line_item_unblended_cost)", 6) + """ as cost
    from cur where line_item_line_item_type is distinct from 'Tax' group by line_item_line_item_type""", [O.CUR_CTE]))
def tax_filter_q(spark, sf_dir):
    t = N.drop_tax_rows(cur(spark, sf_dir))
    return t.groupBy("line_item_line_item_type").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("line_item_unblended_cost")).alias("cost"))


def _ebs_frame(c: DataFrame) -> DataFrame:
    """CUR rows with a product name column, some of them EBS (for C4)."""
    code = F.when(F.col("line_item_usage_type") == "BoxUsage-7", F.lit("Amazon Elastic Block Store")).otherwise(
        F.col("product_servicecode"))
    name = (F.when(F.col("product_region") == "r1", F.lit("Amazon Elastic Block Store Volume"))
            .when(F.col("product_region") == "r2", F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Amazon "), F.col("product_servicecode"))))
    return c.withColumn("product_servicecode", code).withColumn("product_product_name", name)


EBS_SQL = """ebs as (select * replace (
    case when line_item_usage_type = 'BoxUsage-7' then 'Amazon Elastic Block Store' else product_servicecode end
      as product_servicecode),
    case when product_region = 'r1' then 'Amazon Elastic Block Store Volume' when product_region = 'r2' then null
         else 'Amazon ' || product_servicecode end as product_product_name from cur)"""


@register("ebs_relabel", q("""select case when coalesce(contains(product_product_name, 'Elastic Block Store'), false)
      then 'AmazonEBS' when product_servicecode = 'Amazon Elastic Block Store' then 'AmazonEBS'
      else product_servicecode end as service, count(*) as rows,
    """ + O.pr("sum(line_item_unblended_cost)", 6) + """ as cost
    from ebs where line_item_line_item_type is distinct from 'Tax' group by 1""", [O.CUR_CTE, EBS_SQL]))
def ebs_relabel_q(spark, sf_dir):
    n = N.normalize_aws(_ebs_frame(cur(spark, sf_dir)))
    return n.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("cost")).alias("cost"))


def _dirty_frame(c: DataFrame) -> DataFrame:
    """Unified-looking rows with text numbers, bad dates, bad numbers and missing services (for C6)."""
    ut = F.col("line_item_usage_type")
    return c.select(
        F.when(ut == "BoxUsage-5", F.lit("n/a")).otherwise(F.col("line_item_usage_start_date")).alias("date"),
        F.when((ut == "BoxUsage-2") & (F.col("product_region") == "r3"), F.lit(None).cast("string"))
        .otherwise(F.col("product_servicecode")).alias("service"),
        F.when(ut == "BoxUsage-6", F.lit("bad")).otherwise(F.col("line_item_unblended_cost").cast("string")).alias("cost"),
        F.when(ut == "BoxUsage-3", F.lit("NaN")).otherwise(F.col("line_item_usage_amount").cast("string")).alias("usage"),
        F.col("product_region").alias("region"),
    )


@register("enforce_schema", q("""select service, count(*) as rows, """ + O.pr("sum(cost)", 6) + """ as cost,
    count(usage) as usage_rows, min(date) as first_date, max(date) as last_date from (
      select try_cast(date as date) as date, service, try_cast(cost as double) as cost,
             case when isnan(try_cast(usage as double)) then null else try_cast(usage as double) end as usage
      from (select case when line_item_usage_type = 'BoxUsage-5' then 'n/a' else line_item_usage_start_date end as date,
                   case when line_item_usage_type = 'BoxUsage-2' and product_region = 'r3' then null
                        else product_servicecode end as service,
                   case when line_item_usage_type = 'BoxUsage-6' then 'bad' else cast(line_item_unblended_cost as varchar) end as cost,
                   case when line_item_usage_type = 'BoxUsage-3' then 'NaN' else cast(line_item_usage_amount as varchar) end as usage
            from cur))
    where date is not null and service is not null and cost is not null group by service""", [O.CUR_CTE]))
def enforce_schema_q(spark, sf_dir):
    e = N.enforce_schema(_dirty_frame(cur(spark, sf_dir)))
    return e.groupBy("service").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("cost")).alias("cost"), F.count("usage").alias("usage_rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("cur_extract", q("""select seq, date, service, resource_id, usage_type, usage, cost, region, item_type
    from cur_x""", CUR_BASE))
def cur_extract_q(spark, sf_dir):
    x = C.cur_extract(cur(spark, sf_dir))
    return x.select("seq", "date", "service", "resource_id", "usage_type", "usage", "cost", "region", "item_type")


@register("cur_aggregate", q("select * from cur_agg", CUR_BASE))
def cur_aggregate_q(spark, sf_dir):
    return C.cur_aggregate(C.cur_extract(cur(spark, sf_dir)))


@register("cur_ingest", q("select date, service, cost, usage_type, resource_id, usage, region from cur_agg", CUR_BASE))
def cur_ingest_q(spark, sf_dir):
    return _ingested(spark, sf_dir)


@register("sample_rows", q("select date, service, cost, usage_type, resource_id, usage, region from cur_agg",
                           [O.CUR_CTE, "cur_head as (select * from cur order by all limit 1000)",
                            CUR_X.format(src="cur_head"), CUR_AGG]))
def sample_rows_q(spark, sf_dir):
    return C.cur_ingest(cur(spark, sf_dir), sample_rows=1000)


@register("cur_stats", q("""select count(*) as total_rows, """ + O.pr("sum(cost)", 6) + """ as total_cost,
    count(distinct service) as unique_services, count(distinct resource_id) as unique_resources,
    cast(min(date) as varchar) as date_start, cast(max(date) as varchar) as date_end,
    'date,service,cost,usage_type,resource_id,usage,region' as columns_available from cur_agg""", CUR_BASE))
def cur_stats_q(spark, sf_dir):
    s = C.cur_stats(_ingested(spark, sf_dir))
    return s.withColumn("total_cost", r6("total_cost"))


# ---- E9 / E10 over the raw CUR view
@register("leak_savings_plan", q("""select 'RI_SAVINGS_PLAN_WASTE' as leak_type, 'AWS' as provider,
    'Savings Plans' as service, null::varchar as resource_id,
    'Unused savings plan commitment costing $' || """ + O.fg("total", 2) + """ || ' in this billing period' as reason,
    """ + O.pr("total", 2) + """ as exact_waste from (
      select count(*) as n, coalesce(sum(try_cast(line_item_unblended_cost as double)), 0.0) as total from cur
      where line_item_line_item_type in ('SavingsPlanNegation', 'SavingsPlanRecurringFee'))
    where n > 0 and total >= 10""", [O.CUR_CTE]))
def leak_savings_plan_q(spark, sf_dir):
    return E.detect_savings_plan(cur(spark, sf_dir)).select(*LEAK_OUT, "exact_waste")


@register("leak_unused_ri", q("""select 'RI_UNUSED_RESERVATION' as leak_type, 'AWS' as provider,
    'Reserved Instances' as service, null::varchar as resource_id,
    'Unused reserved capacity costing $' || """ + O.fg("t.total", 2) + """ || ' (' || d.detail || ')' as reason,
    """ + O.pr("t.total", 2) + """ as exact_waste
    from (select count(*) as n, coalesce(sum(try_cast(reservation_unused_recurring_fee as double)), 0.0) as total
          from cur where coalesce(try_cast(reservation_unused_quantity as double), 0.0) > 0) t,
         (select string_agg(product_servicecode || ': $' || """ + O.fg("fee", 2) + """, ', '
                 order by fee desc, product_servicecode) as detail
          from (select product_servicecode, fee, row_number() over (order by fee desc, product_servicecode) as rk
                from (select product_servicecode, coalesce(sum(try_cast(reservation_unused_recurring_fee as double)), 0.0) as fee
                      from cur where coalesce(try_cast(reservation_unused_quantity as double), 0.0) > 0
                        and product_servicecode is not null group by product_servicecode))
          where rk <= 3) d
    where t.n > 0 and t.total >= 10""", [O.CUR_CTE]))
def leak_unused_ri_q(spark, sf_dir):
    return E.detect_unused_reservation(cur(spark, sf_dir)).select(*LEAK_OUT, "exact_waste")


# ================================================================== I: exploratory aggregates
@register("cost_by_service", q("select service, " + O.pr("sum(cost)", 6) + " as cost from cur_agg group by service",
                               CUR_BASE))
def cost_by_service_q(spark, sf_dir):
    return I.cost_by_service(_ingested(spark, sf_dir)).withColumn("cost", r6("cost"))


@register("top_resources", q("select resource_id, " + O.pr("sum(cost)", 6) + """ as cost from cur_agg
    where resource_id <> '' group by resource_id order by sum(cost) desc, resource_id limit 10""", CUR_BASE))
def top_resources_q(spark, sf_dir):
    return I.top_resources(_ingested(spark, sf_dir)).withColumn("cost", r6("cost"))


@register("inefficient_resources", q("""select service, resource_id, """ + O.pr("sum(cost)", 6) + """ as cost
    from (select *, cost / (usage + 0.001) as cpu from cur_agg)
    where cpu > (select quantile_cont(cost / (usage + 0.001), 0.9) from cur_agg)
    group by service, resource_id order by sum(cost) desc, service, resource_id limit 10""", CUR_BASE))
def inefficient_resources_q(spark, sf_dir):
    return I.inefficient_resources(_ingested(spark, sf_dir)).withColumn("cost", r6("cost"))


@register("daily_total", q("select date, " + O.pr("sum(cost)", 6) + " as cost from cur_agg group by date", CUR_BASE))
def daily_total_q(spark, sf_dir):
    return I.daily_total(_ingested(spark, sf_dir)).withColumn("cost", r6("cost"))


PIVOT_SERVICES = ["EC2", "Lambda", "RDS", "S3"]  # the services that the tables hold; the query itself finds them


@register("daily_service_pivot", q("select date, " + ", ".join(
    f"{O.pr(f'coalesce(sum(case when service = {chr(39)}{s}{chr(39)} then cost end), 0.0)', 6)} as \"{s}\""
    for s in PIVOT_SERVICES) + " from cur_agg group by date", CUR_BASE))
def daily_service_pivot_q(spark, sf_dir):
    p = I.daily_service_pivot(_ingested(spark, sf_dir))
    return p.select("date", *[r6(F.col(f"`{s}`")).alias(s) for s in p.columns if s != "date"])


@register("service_usage_types", q("select usage_type, " + O.pr("sum(cost)", 6) + """ as cost from cur_agg
    where service = 'EC2' group by usage_type""", CUR_BASE))
def service_usage_types_q(spark, sf_dir):
    return I.service_usage_types(_ingested(spark, sf_dir), "EC2").withColumn("cost", r6("cost"))


# ================================================================== H, A5-A7, A10: reporting
from pyspark.sql import Window  # noqa: E402

from costsieve.operators import enrich as G  # noqa: E402
from costsieve.operators import report as H  # noqa: E402
from costsieve.session import scratch_path  # noqa: E402

PREV_CUTOFF = "2024-01-16"  # the "previous run" saw the first half of the month
DELTA_CTES = BASE + O.pipeline_ctes(where=f"date < date '{PREV_CUTOFF}'", prefix="prev_") + [
    """prev_ids as (select coalesce(leak_type, 'None') || '::' || coalesce(provider, 'None') || '::'
        || coalesce(service, 'None') || '::' || coalesce(resource_id, 'None') as leak_id from prev_primary_leaks)""",
    """tagged as (select p.*, case when exists (select 1 from prev_ids i where i.leak_id = p.leak_id)
        then 'EXISTING' else 'NEW' end as status from (
          select *, coalesce(leak_type, 'None') || '::' || coalesce(provider, 'None') || '::'
            || coalesce(service, 'None') || '::' || coalesce(resource_id, 'None') as leak_id from primary_order) p)""",
]


def _tagged(spark, sf_dir):
    """Current primary leaks tagged NEW / EXISTING against a previous run's id snapshot."""
    b = billing(spark, sf_dir)
    prev = analyze(b.where(F.col("date") < F.lit(PREV_CUTOFF).cast("date")), already_normalized=True)
    snapshot = scratch_path(spark, "leak-ids")
    H.save_current_ids(prev.primary, snapshot, "run-1")
    cur_run = analyze(b, already_normalized=True)
    return H.apply_delta(cur_run.primary, H.load_previous_ids(spark, snapshot, "run-2"))


@register("delta_status", q("select leak_type, provider, service, resource_id, leak_id, status from tagged", DELTA_CTES))
def delta_status_q(spark, sf_dir):
    return _tagged(spark, sf_dir).select("leak_type", "provider", "service", "resource_id", "leak_id", "status")


@register("report_summary", q(f"""select count(*) as total_leaks, cast(count_if(status = 'NEW') as bigint) as new_leaks,
    cast(count_if(severity = 'HIGH') as bigint) as high, cast(count_if(severity = 'MEDIUM') as bigint) as medium, cast(count_if(severity = 'LOW') as bigint) as low,
    {O.money('coalesce(sum(estimated_monthly_waste), 0.0)')} as estimated_total_monthly_waste_usd,
    {O.money('coalesce(sum(estimated_monthly_waste), 0.0) * 12')} as estimated_total_annual_waste_usd
    from tagged""", DELTA_CTES))
def report_summary_q(spark, sf_dir):
    return H.report_summary(_tagged(spark, sf_dir))


@register("report_table", q("""select primary_pos as row_no, severity, leak_type, service,
    substring(case when resource_id is not null and resource_id <> '' then resource_id else 'N/A' end, 1, 30) as resource,
    estimated_monthly_waste, confidence, status from tagged""", DELTA_CTES))
def report_table_q(spark, sf_dir):
    return H.report_table(_tagged(spark, sf_dir))


@register("high_findings", q("""select leak_type, provider, service, resource_id, estimated_monthly_waste from primary_order
    where severity = 'HIGH' order by primary_pos limit 15"""))
def high_findings_q(spark, sf_dir):
    return H.high_findings(_analysis(spark, sf_dir).primary).select(
        "leak_type", "provider", "service", "resource_id", "estimated_monthly_waste")


@register("sanitize_floats", q("""select seq, strftime(date, '%Y-%m-%d') as date,
    case when seq % 7 in (0, 1, 2) then null else cost end as x from billing""", [O.BILLING_CTE]))
def sanitize_floats_q(spark, sf_dir):
    b = billing(spark, sf_dir)
    k = F.col("seq") % 7
    x = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf")))
         .when(k == 2, F.lit(float("-inf"))).otherwise(F.col("cost")))
    return H.sanitize_frame(b.select("seq", "date", x.alias("x")))


@register("leak_type_rollup", q(f"""select leak_type, count(*) as findings, cast(count_if(severity = 'HIGH') as bigint) as high,
    cast(count_if(severity = 'MEDIUM') as bigint) as medium, cast(count_if(severity = 'LOW') as bigint) as low, cast(count_if(status = 'NEW') as bigint) as new,
    {O.money('sum(estimated_monthly_waste)')} as monthly_waste, any_value(priority) as priority
    from tagged group by leak_type""", DELTA_CTES))
def leak_type_rollup_q(spark, sf_dir):
    return H.leak_type_rollup(_tagged(spark, sf_dir))


_NL = "chr(10)"


@register("insights", q(f"""select '[' || severity || '] ' || leak_type || ' detected in ' || provider || ' ' || service
    || {_NL} || '→ Resource: ' || coalesce(resource_id, 'None') || {_NL} || '→ Reason: ' || reason
    || {_NL} || '→ Recommended action: ' || recommended_action as insight from primary_order"""))
def insights_q(spark, sf_dir):
    return H.insights(_analysis(spark, sf_dir).primary)


@register("filter_severity", q(f"select {SCORED_SQL_OUT} from primary_order where severity = 'HIGH'"))
def filter_severity_q(spark, sf_dir):
    return H.filter_severity(_analysis(spark, sf_dir).primary, "HIGH").select(*SCORED_OUT)


@register("convert_currency", q(f"""select leak_type, provider, service, resource_id, 'EUR' as currency, 0.92e0 as rate,
    {O.pr('estimated_monthly_waste * 0.92e0', 6)} as estimated_monthly_waste,
    {O.pr('estimated_annual_waste * 0.92e0', 6)} as estimated_annual_waste
    from primary_order"""))
def convert_currency_q(spark, sf_dir):
    p = _analysis(spark, sf_dir).primary.select(
        "leak_type", "provider", "service", "resource_id", "estimated_monthly_waste", "estimated_annual_waste")
    c = H.convert_currency(p, "EUR", ["estimated_monthly_waste", "estimated_annual_waste"])
    return c.select("leak_type", "provider", "service", "resource_id", "currency", "rate",
                    r6("estimated_monthly_waste").alias("estimated_monthly_waste"),
                    r6("estimated_annual_waste").alias("estimated_annual_waste"))


@register("forecast_top", q("""select *, trend_pct > 15 as trend_alert from forecast
    order by projected_monthly_cost desc, provider, service limit 10""", FORECAST_CTES))
def forecast_top_q(spark, sf_dir):
    return H.forecast_top(D.forecast_30d(D.daily_cost(billing(spark, sf_dir))))


# ================================================================== G: enrichment (set-based)
CAND_CTES = BASE + ["""cand as (select *, row_number() over (order by primary_pos) as cand_pos from (
    select * from primary_order where severity in ('HIGH', 'MEDIUM') order by primary_pos limit 10))"""]


def _candidates(spark, sf_dir):
    c = G.enrich_candidates(_analysis(spark, sf_dir).primary)
    # at most ENRICH_MAX rows: a window over them is bounded by construction
    return c.withColumn("cand_pos", F.row_number().over(Window.orderBy("first_key")))


@register("enrich_candidates", q("select leak_type, provider, service, resource_id, severity, cand_pos from cand",
                                 CAND_CTES))
def enrich_candidates_q(spark, sf_dir):
    return _candidates(spark, sf_dir).select("leak_type", "provider", "service", "resource_id", "severity",
                                             F.col("cand_pos").cast("long").alias("cand_pos"))


def _jv(col: str) -> str:
    return f"coalesce(cast(to_json({col}) as varchar), 'null')"


_PROMPT_SQL = ("'" + G.PROMPT_HEAD.replace("\n", "' || chr(10) || '") + "' || '{' || chr(10) || " + " || ".join(
    f"'  \"{name}\": ' || {_jv(name)} || '{',' if i < len(G.PROMPT_FIELDS) - 1 else ''}' || chr(10)"
    for i, name in enumerate(G.PROMPT_FIELDS)) + " || '}' || '" + G.PROMPT_TAIL.replace("\n", "' || chr(10) || '")
    + "'")


@register("enrich_prompts", q(f"select leak_type, provider, service, resource_id, {_PROMPT_SQL} as prompt from cand",
                              CAND_CTES))
def enrich_prompts_q(spark, sf_dir):
    return G.enrich_prompts(_candidates(spark, sf_dir))


def _replies(cands: DataFrame) -> DataFrame:
    """Replies derived from the candidates: fenced JSON, bare JSON, or not JSON at all."""
    body = F.to_json(F.struct(
        F.col("reason").alias("root_cause"),
        F.concat(F.lit("review "), F.coalesce(F.col("resource_id"), F.col("service"))).alias("fix_command"),
        F.col("severity_score").alias("estimated_remediation_minutes"),
        F.col("severity").alias("risk_level"), F.col("confidence").alias("risk_note"),
        F.col("recommended_action").alias("priority_reason"),
    ))
    k = F.col("cand_pos") % 3
    reply = (F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(k == 1, body).otherwise(F.concat(F.lit("not json: "), F.col("reason"))))
    return cands.select(*G.LEAK_KEY, "cand_pos", reply.alias("reply"))


REC_FIELDS = [f.name for f in G.RECOMMENDATION.fields]
_REC_SQL = """recs as (select leak_type, provider, service, resource_id, cand_pos,
    case when cand_pos % 3 <> 2 then reason end as root_cause,
    case when cand_pos % 3 <> 2 then 'review ' || coalesce(resource_id, service) end as fix_command,
    case when cand_pos % 3 <> 2 then severity_score end as estimated_remediation_minutes,
    case when cand_pos % 3 <> 2 then severity end as risk_level,
    case when cand_pos % 3 <> 2 then confidence end as risk_note,
    case when cand_pos % 3 <> 2 then recommended_action end as priority_reason from cand)"""


@register("parse_recommendations", q("select leak_type, provider, service, resource_id, " + ", ".join(REC_FIELDS)
                                     + " from recs", CAND_CTES + [_REC_SQL]))
def parse_recommendations_q(spark, sf_dir):
    parsed = G.parse_recommendations(_replies(_candidates(spark, sf_dir)))
    return parsed.select(*G.LEAK_KEY, *[F.col(f"llm_recommendation.{f}").alias(f) for f in REC_FIELDS])


@register("attach_recommendations", q("""select p.leak_type, p.provider, p.service, p.resource_id,
    r.root_cause, r.risk_level from primary_order p left join recs r
    on r.leak_type = p.leak_type and r.provider is not distinct from p.provider
    and r.service is not distinct from p.service and r.resource_id is not distinct from p.resource_id""",
                                      CAND_CTES + [_REC_SQL]))
def attach_recommendations_q(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    cands = G.enrich_candidates(a.primary).withColumn(
        "cand_pos", F.row_number().over(Window.orderBy("first_key")))
    attached = G.attach_recommendations(a.primary, G.parse_recommendations(_replies(cands)))
    return attached.select("leak_type", "provider", "service", "resource_id",
                           F.col("llm_recommendation.root_cause").alias("root_cause"),
                           F.col("llm_recommendation.risk_level").alias("risk_level"))


# ================================================================== A8, A9: saved API payloads
from costsieve.operators import detect as B  # noqa: E402
from costsieve.sources import landing as L  # noqa: E402
from costsieve.sources import payloads as A  # noqa: E402

API_REGION = "us-east-1"


@register("flatten_aws_api", q(f"""select date, service, {O.pr('sum(cost)', 6)} as cost,
    case when service = 'AmazonS3' then 0.0 else {O.pr('sum(usage)', 6)} end as usage,
    'AWS' as provider, '' as resource_id, '{API_REGION}' as region
    from billing where provider = 'AWS' group by date, service having sum(cost) > 0""", [O.BILLING_CTE]))
def flatten_aws_api_q(spark, sf_dir):
    path = scratch_path(spark, "ce-pages")
    A.aws_pages_from_billing(billing(spark, sf_dir)).write.json(path)
    flat = A.flatten_aws_cost_explorer(A.read_aws_pages(spark, path), API_REGION)
    return flat.select("date", "service", r6("cost").alias("cost"), r6("usage").alias("usage"),
                       "provider", "resource_id", "region")


@register("flatten_azure_api", q(f"""select date, service, {O.pr('sum(cost)', 6)} as cost, 0.0::double as usage,
    'AZURE' as provider, '' as resource_id, '' as region
    from billing where provider = 'AZURE' and service <> 'Storage' group by date, service having sum(cost) > 0""",
                                 [O.BILLING_CTE]))
def flatten_azure_api_q(spark, sf_dir):
    path = scratch_path(spark, "cm-pages")
    A.azure_pages_from_billing(billing(spark, sf_dir)).write.json(path)
    flat = A.flatten_azure_query(A.read_azure_pages(spark, path))
    return flat.select("date", "service", r6("cost").alias("cost"), "usage", "provider", "resource_id", "region")


# ================================================================== C7-C10: Azure / GCP exports read from CSV
def _landing_export(spark, sf_dir, layout):
    return L.read_csv_export(spark, L.write_export(layout(billing(spark, sf_dir)), layout.__name__))


NORM_OUT = ["date", "provider", "service", "resource_id", "region"]


AZURE_SQL = q("""select date, 'AZURE' as provider, service, resource_id, region, cost, usage,
    case when labels_owner is not null and region = 'r0' then 'apollo' end as labels_project,
    labels_owner,
    case when labels_owner is not null then case when cost > 20 then 'prod' else 'dev' end end as labels_environment
    from billing where provider = 'AZURE'""", [O.BILLING_CTE])


@register("normalize_azure", AZURE_SQL)
def normalize_azure_q(spark, sf_dir):
    return _normalized_azure(spark, sf_dir, L.azure_export)


def _normalized_azure(spark, sf_dir, layout):
    n = N.normalize(_landing_export(spark, sf_dir, layout), "AZURE")
    return n.select(*NORM_OUT, "cost", "usage", "labels_project", "labels_owner", "labels_environment")


@register("normalize_azure_ea", AZURE_SQL)
def normalize_azure_ea_q(spark, sf_dir):
    return _normalized_azure(spark, sf_dir, L.azure_ea_export)


@register("normalize_azure_mca", AZURE_SQL)
def normalize_azure_mca_q(spark, sf_dir):
    return _normalized_azure(spark, sf_dir, L.azure_mca_export)


@register("normalize_day_first", AZURE_SQL)
def normalize_day_first_q(spark, sf_dir):
    """An export that writes days before months throughout; many of its texts fit both orders."""
    return _normalized_azure(spark, sf_dir, L.azure_day_first_export)


@register("azure_tags", q("""select labels_owner, labels_environment, labels_project, count(*) as rows from (
    select labels_owner,
      case when labels_owner is not null then case when cost > 20 then 'prod' else 'dev' end end as labels_environment,
      case when labels_owner is not null and region = 'r0' then 'apollo' end as labels_project
    from billing where provider = 'AZURE') group by all""", [O.BILLING_CTE]))
def azure_tags_q(spark, sf_dir):
    x = _landing_export(spark, sf_dir, L.azure_export)
    tags = x.select(*N.azure_tags(N.pick(x, N.AZURE_CANDIDATES["tags"])))
    return tags.groupBy("labels_owner", "labels_environment", "labels_project").agg(F.count(F.lit(1)).alias("rows"))


@register("normalize_gcp", q("""select date, 'GCP' as provider, service,
    case when seq % 10 <> 0 then resource_id else 'unknown' end as resource_id, region, cost, usage,
    case when labels_owner is not null then 'prod' end as labels_environment
    from billing where provider = 'GCP'""", [O.BILLING_CTE]))
def normalize_gcp_q(spark, sf_dir):
    n = N.normalize(_landing_export(spark, sf_dir, L.gcp_export), "GCP")
    return n.select(*NORM_OUT, "cost", "usage", "labels_environment")


# ================================================================== B: landing-zone detection
# Every file of the zone is classified; an account's answer follows from its rows.
ACCOUNT_CTE = """acct as (select *, least(cast(regexp_extract(resource_id, '([0-9]+)$', 1) as int), 24) as account from billing)"""
OTHER_ACCOUNTS = """(select distinct cast(o_orderkey % 5 + 100 as varchar) as source, 'INVOICE' as file_kind from orders
    union all select distinct cast(n_regionkey + 200 as varchar), 'UNKNOWN' from nation)"""


def _headers(heads):
    return L.headers_of(heads).withColumnRenamed("file", "source")


@register("detect_provider", q(f"""select cast(account as varchar) as source, bool_or(provider = 'AWS') as is_aws,
      bool_or(provider = 'AZURE') as is_azure, bool_or(provider = 'GCP') as is_gcp,
      case when count(distinct provider) = 1 then min(provider) end as provider, count(distinct provider) > 1 as mixed
    from acct group by account
    union all select source, false, false, false, null, false from {OTHER_ACCOUNTS}""", [O.BILLING_CTE, ACCOUNT_CTE]))
def detect_provider_q(spark, sf_dir):
    files = B.detect_provider_files(_headers(L.file_heads(spark, L.write_accounts(spark, sf_dir))))
    return B.provider_by_export(files, L.export_name(F.col("source")))


@register("detect_file_kind", q(f"""select cast(account as varchar) as source, string_agg(distinct kind, '+' order by kind) as file_kind
    from (select account, case when provider = 'AWS' and account % 2 = 1 then 'UNKNOWN' else 'COST_USAGE' end as kind from acct)
    group by account union all select source, file_kind from {OTHER_ACCOUNTS}""", [O.BILLING_CTE, ACCOUNT_CTE]))
def detect_file_kind_q(spark, sf_dir):
    files = B.detect_file_kind(_headers(L.file_heads(spark, L.write_accounts(spark, sf_dir))))
    return B.kind_by_export(files, L.export_name(F.col("source")))


@register("validate_billing", q("""select source, cast(rows as bigint) as rows, has_cost_signal, has_cost_signal as is_valid,
    kind || case when has_cost_signal then ' is valid for analysis' else ' does not contain cost or usage data' end as message from (
    select cast(account as varchar) as source, count(*) as rows, true as has_cost_signal,
      case when account % 4 = 0 and bool_and(provider = 'AWS') then 'Parquet' else 'CSV' end as kind from acct group by account
    union all select cast(o_orderkey % 5 + 100 as varchar), count(*), true, 'CSV' from orders group by 1
    union all select cast(n_regionkey + 200 as varchar), count(*), false, 'CSV' from nation group by 1)""", [O.BILLING_CTE, ACCOUNT_CTE]))
def validate_billing_q(spark, sf_dir):
    root = L.write_accounts(spark, sf_dir)
    heads = L.file_heads(spark, root)
    rows = L.file_row_counts(spark, root, heads).withColumnRenamed("file", "source")
    return B.validity_by_export(B.validate_billing_files(_headers(heads), rows), L.export_name(F.col("source")))


@register("cur_column_map", q("""select distinct cast(account as varchar) as source, raw_column, standard_name
    from acct join (values (0, 'line_item_usage_start_date', 'date'), (0, 'product_servicecode', 'service'),
      (0, 'line_item_resource_id', 'resource_id'), (0, 'line_item_usage_type', 'usage_type'), (0, 'line_item_usage_amount', 'usage'),
      (0, 'line_item_unblended_cost', 'cost'), (0, 'product_region', 'region'), (0, 'line_item_line_item_type', 'item_type'),
      (0, 'pricing_currency', 'currency'), (1, 'line_item_usage_type', 'usage_type'), (1, 'pricing_currency', 'currency'))
      t(odd, raw_column, standard_name) on account % 2 = odd where provider = 'AWS'""", [O.BILLING_CTE, ACCOUNT_CTE]))
def cur_column_map_q(spark, sf_dir):
    files = B.cur_column_map_files(_headers(L.file_heads(spark, L.write_accounts(spark, sf_dir))))
    return B.cur_map_by_export(files, L.export_name(F.col("source")))


# ================================================================== C: dirty CSV export
DIRTY_TAIL = "T23:30:00-05:00"


def _dirty_export(c: DataFrame) -> DataFrame:
    """CUR rows as a careless export has them: many date layouts by line and order number, null tokens,
    bad numbers, an owner column with a dot in its name."""
    d, line = F.to_date("line_item_usage_start_date"), F.regexp_extract("line_item_usage_type", r"(\d+)$", 1)
    layouts = {"1": ["yyyy-MM-dd", "d MMMM yyyy", "yyyy.MM.dd"], "2": ["M/d/yyyy", "MM/dd/yy", "M-d-yyyy"],
               "3": ["d-MMM-yyyy", "dd-MMM-yy", "MMM d yyyy"], "5": ["yyyyMMdd", "yyyyMMdd'T'HHmmss'Z'", "MMMM d, yyyy"]}
    kind = F.floor(F.col("seq") / 100) % 3
    date = F.when(line == "4", F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(DIRTY_TAIL))).when(line == "6", F.date_format(d, "yyyyMM"))
    for number, three in layouts.items():
        for k, layout in enumerate(three):
            date = date.when((line == number) & (kind == k), F.date_format(d, layout))
    date = date.otherwise(F.lit("NA"))
    return c.select(
        "seq", date.alias("lineItem/UsageStartDate"), F.col("product_servicecode").alias("product/servicecode"),
        F.when(F.col("product_region") == "r1", F.lit("NA")).when(F.col("product_region") == "r2", F.lit("null"))
        .otherwise(F.col("line_item_resource_id")).alias("lineItem/ResourceId"),
        F.when(F.col("product_region") == "r3", F.lit("None")).otherwise(F.col("line_item_usage_amount").cast("string")).alias("lineItem/UsageAmount"),
        F.when(F.col("product_region") == "r4", F.concat(F.lit(" "), F.col("line_item_unblended_cost").cast("string")))
        .otherwise(F.col("line_item_unblended_cost").cast("string")).alias("lineItem/UnblendedCost"),
        F.col("line_item_line_item_type").alias("lineItem/LineItemType"),
        F.when(line == "1", F.lit("N/A")).otherwise(F.concat(F.lit("team-"), line)).alias("labels.owner"))


@register("normalize_dirty", q("""select seq, strptime(line_item_usage_start_date, '%Y-%m-%d')::date as date, product_servicecode as service,
      case when product_region in ('r1', 'r2') then null else line_item_resource_id end as resource_id,
      case when product_region <> 'r3' then line_item_usage_amount end as usage, line_item_unblended_cost as cost,
      case when line_item_usage_type <> 'BoxUsage-1' then 'team-' || right(line_item_usage_type, 1) end as owner
    from cur where right(line_item_usage_type, 1) in ('1', '2', '3', '4', '5') and line_item_line_item_type is distinct from 'Tax'""",
                               [O.CUR_CTE]))
def normalize_dirty_q(spark, sf_dir):
    path = L.write_export(_dirty_export(cur(spark, sf_dir)), "dirty.csv")
    n = N.normalize(L.load_export(spark, path), "AWS")
    return n.select(F.col("seq").cast("long").alias("seq"), "date", "service", "resource_id", "usage", "cost", F.col("`labels.owner`").alias("owner"))


@register("normalize_rejects", q("""select seq, case when line_item_line_item_type = 'Tax' then 'tax line'
      when right(line_item_usage_type, 1) = '6' then 'date unreadable: ' || strftime(strptime(line_item_usage_start_date, '%Y-%m-%d'), '%Y%m')
      else 'date missing' end as reject_reason
    from cur where right(line_item_usage_type, 1) not in ('1', '2', '3', '4', '5') or line_item_line_item_type = 'Tax'""", [O.CUR_CTE]))
def normalize_rejects_q(spark, sf_dir):
    """The rows that ``normalize_dirty`` drops, and why."""
    path = L.write_export(_dirty_export(cur(spark, sf_dir)), "dirty.csv")
    return N.rejected_rows(L.load_export(spark, path), "AWS").select(F.col("seq").cast("long").alias("seq"), "reject_reason")


@register("commitments_slash", q("select leak_type, reason, exact_waste from ri_sp union all select leak_type, reason, exact_waste from ri_un",
                                 [O.CUR_CTE] + O.RI_LEAK_CTES))
def commitments_slash_q(spark, sf_dir):
    """E9 and E10 over the slash layout, from one pass over the rows."""
    from costsieve.plans.pipeline import underscore_names

    totals = E.commitment_totals(underscore_names(L.cur_slash_export(cur(spark, sf_dir))))
    both = E.savings_plan_leak(totals).select("leak_type", "reason", "exact_waste")
    return both.unionByName(E.unused_reservation_leak(totals).select("leak_type", "reason", "exact_waste"))


@register("cost_projection", q("""select date, service, cost, usage, resource_id, region, 'AWS' as provider from cur_agg""", CUR_BASE))
def cost_projection_q(spark, sf_dir):
    return I.pipeline_projection(_ingested(spark, sf_dir))


@register("json_report", q(f"""select 'summary' as section, null::varchar as leak_type, null::varchar as service, null::varchar as resource_id,
      count(*)::double as value, null::varchar as status from tagged
    union all select 'leaks', leak_type, service, resource_id, estimated_monthly_waste, status from tagged""", DELTA_CTES))
def json_report_q(spark, sf_dir):
    """A5: the report written as JSON and read back."""
    tagged = _tagged(spark, sf_dir).drop("rank_key", "first_key")
    summary, path = H.report_summary(tagged), scratch_path(spark, "report")
    H.write_json_report(path, summary, tagged, None, summary)
    back = H.read_json_report(spark, path, {"summary": summary.schema, "leaks": tagged.schema})
    none = F.lit(None).cast("string")
    return back["summary"].select(
        F.lit("summary").alias("section"), none.alias("leak_type"), none.alias("service"), none.alias("resource_id"),
        F.col("total_leaks").cast("double").alias("value"), none.alias("status")).unionByName(
        back["leaks"].select(F.lit("leaks").alias("section"), "leak_type", "service", "resource_id",
                             F.col("estimated_monthly_waste").alias("value"), "status"))


# ================================================================== end to end over a raw AWS CUR export
CUR_PIPELINE_CTES = [O.CUR_CTE, O.CUR_NORM_CTE] + O.RI_LEAK_CTES + O.pipeline_ctes(
    source="cur_norm", extra_leaks=["ri_sp", "ri_un"])


@register("cur_pipeline", q(f"select {SCORED_SQL_OUT}, primary_key, primary_pos from primary_order",
                            CUR_PIPELINE_CTES))
def cur_pipeline_q(spark, sf_dir):
    """Provider detection -> AWS normalization (Tax dropped) -> all detectors incl. the
    commitment ones on the raw rows -> scored primary leaks with report positions."""
    from costsieve.operators.ranking import global_positions

    a = analyze(cur(spark, sf_dir))
    p = global_positions(a.primary, [F.col("first_key")], "primary_pos")
    return p.select(*SCORED_OUT, "primary_key", F.col("primary_pos").cast("long").alias("primary_pos"))
