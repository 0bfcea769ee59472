"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written from the operator semantics, not generated from the Spark plans.
Views ``events`` and ``lineitem`` (and the other driver tables) are expected to exist;
the billing views of FIXTURES.md are inlined as CTEs.
"""

from __future__ import annotations

# ---- fixed values, stated here once more so that a slip in the library can't hide ----
COMPUTE_SERVICES = ["ec2", "virtual machines", "compute engine"]
STORAGE_SERVICES = ["s3", "storage", "cloud storage"]
SERVERLESS_SERVICES = ["lambda", "functions", "cloud functions"]
DATABASE_SERVICES = ["rds", "sql", "cosmos", "cloud sql"]
COMPUTE_KEYWORDS = {
    "aws": ["ec2"],
    "azure": ["virtual machines"],
    "gcp": ["compute engine"],
}
STORAGE_KEYWORDS = {
    "aws": ["ebs", "s3"],
    "azure": ["disk", "storage"],
    "gcp": ["persistent disk", "cloud storage"],
}
SNAPSHOT_KEYWORDS = {
    "aws": ["snapshot"],
    "azure": ["snapshot", "backup"],
    "gcp": ["snapshot"],
}
BLOCK_STORAGE_KEYWORDS = {
    "aws": ["ebs", "volume"],
    "azure": ["disk"],
    "gcp": ["persistent disk"],
}
LEAK_TYPE_WEIGHTS = {
    "RI_SAVINGS_PLAN_WASTE": 50,
    "RI_UNUSED_RESERVATION": 50,
    "ZOMBIE_RESOURCE": 60,
    "RUNAWAY_COST": 55,
    "ALWAYS_ON_HIGH_COST": 35,
    "IDLE_DATABASE": 30,
    "ORPHANED_STORAGE": 25,
    "IDLE_RESOURCE": 20,
    "SNAPSHOT_SPRAWL": 15,
    "UNTAGGED_RESOURCE": 10,
}
REASON_BONUSES = [
    (["grew", "increase", "spike", "stddevs above"], 10),
    (["30 days", "60 days", "90 days", "long-running"], 10),
    (["storage", "snapshot", "backup", "egress"], 5),
    (["no ownership", "untagged"], 5),
]
WASTE_MULTIPLIERS = {
    "ZOMBIE_RESOURCE": 1.0,
    "IDLE_RESOURCE": 1.0,
    "IDLE_DATABASE": 1.0,
    "ALWAYS_ON_HIGH_COST": 1.0,
    "RUNAWAY_COST": 0.3,
    "ORPHANED_STORAGE": 0.5,
    "SNAPSHOT_SPRAWL": 0.3,
    "UNTAGGED_RESOURCE": 0.2,
}
LEAK_PRIORITY = {
    "RI_SAVINGS_PLAN_WASTE": 120,
    "RI_UNUSED_RESERVATION": 120,
    "RUNAWAY_COST": 100,
    "ALWAYS_ON_HIGH_COST": 90,
    "ZOMBIE_RESOURCE": 80,
    "IDLE_DATABASE": 70,
    "IDLE_RESOURCE": 60,
    "ORPHANED_STORAGE": 50,
    "SNAPSHOT_SPRAWL": 40,
    "UNTAGGED_RESOURCE": 30,
}
SEVERITY_ACTIONS = {
    "HIGH": "Immediate investigation and remediation required",
    "MEDIUM": "Review and schedule remediation within this sprint",
    "LOW": "Monitor — clean up when convenient",
}
SERVICE_CODE_MAPPING = {
    "AmazonEC2": "EC2",
    "AmazonRDS": "RDS",
    "AmazonS3": "S3",
    "AWSLambda": "Lambda",
    "AmazonDynamoDB": "DynamoDB",
    "AmazonElastiCache": "ElastiCache",
    "AmazonESG": "Elasticsearch",
    "AmazonCloudFront": "CloudFront",
    "AmazonSNS": "SNS",
    "AmazonSQS": "SQS",
    "AWSKms": "KMS",
    "AmazonVPC": "VPC",
    "AWSCloudTrail": "CloudTrail",
}
# ---- end of fixed values ----

BILLING_CTE = """billing as (
  with e as (select event_id, cast(ts as date) as date, user_id, value, event_type,
      cast(json_extract_string(props,'$.k') as int) as k,
      case user_id%3 when 0 then 'AWS' when 1 then 'AZURE' else 'GCP' end as provider,
      user_id%30 as rid, datediff('day', date '2024-01-01', cast(ts as date)) as dn
    from events),
  s as (select *, case event_type
      when 'purchase' then case provider when 'AWS' then 'AmazonEC2' when 'AZURE' then 'Virtual Machines' else 'Compute Engine' end
      when 'view'     then case provider when 'AWS' then 'AmazonRDS' when 'AZURE' then 'SQL Database' else 'Cloud SQL' end
      when 'click'    then case provider when 'AWS' then 'AmazonEBS' when 'AZURE' then 'Managed Disk' else 'Persistent Disk' end
      when 'signup'   then case provider when 'AWS' then 'AmazonS3' when 'AZURE' then 'Storage' else 'Cloud Storage' end
      else case provider when 'AWS' then 'EBS Snapshot' when 'AZURE' then 'Backup' else 'Snapshot' end end as service
    from e)
  select event_id as seq, date, provider, service,
    case when event_type='signup' then value*(1e0+dn*dn/50e0) else value end as cost,
    case when event_type='signup' then k*0.05e0 else k*0.2e0 end as usage,
    case when event_type='error' and rid%2=0 then 'purchase' else event_type end||'-'||cast(rid as varchar) as resource_id,
    case when event_type='purchase' then 'r'||cast(rid%4 as varchar) else 'r'||cast(rid%5 as varchar) end as region,
    case when provider='AZURE' or (rid%5=0 and not (provider='GCP' and event_type='view'))
         then 'team-'||cast(rid%3 as varchar) end as labels_owner
  from s)"""

CUR_CTE = """cur as (
  select l_orderkey*100 + l_linenumber as seq,
    strftime(l_shipdate,'%Y-%m-%d') as line_item_usage_start_date,
    case l_suppkey%4 when 0 then 'AmazonEC2' when 1 then 'AmazonRDS' when 2 then 'AmazonS3' else 'AWSLambda' end as product_servicecode,
    'i-'||cast(l_partkey as varchar) as line_item_resource_id,
    'BoxUsage-'||cast(l_linenumber as varchar) as line_item_usage_type,
    l_quantity as line_item_usage_amount, l_extendedprice/1000e0 as line_item_unblended_cost,
    'r'||cast(l_suppkey%5 as varchar) as product_region,
    case when l_linenumber=1 and l_returnflag='A' then 'SavingsPlanRecurringFee'
         when l_linenumber=2 and l_returnflag='R' then 'SavingsPlanNegation'
         when l_linenumber=3 and l_returnflag='N' then 'Tax' else 'Usage' end as line_item_line_item_type,
    case when l_linenumber=4 then l_quantity else 0e0 end as reservation_unused_quantity,
    l_tax*100e0 as reservation_unused_recurring_fee
  from lineitem)"""


# ---------------------------------------------------------------- SQL expression helpers
def pr(expr: str, d: int) -> str:
    """Python round(x, d) on doubles (exact binary value)."""
    return f"(cast(printf('%.{d}f', {expr}) as double) + 0.0)"


def money(expr: str, d: int = 2) -> str:
    """money(): round to 9 decimals first (summation noise), then Python-round."""
    return pr(pr(expr, 9), d)


def ff(expr: str, d: int) -> str:
    """f'{x:.df}'."""
    return f"printf('%.{d}f', {expr})"


def fg(expr: str, d: int) -> str:
    """f'{x:,.df}'."""
    return "format('{:,." + str(d) + "f}', " + expr + ")"


def _any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def category(col: str = "service") -> str:
    s = f"lower({col})"
    return (f"(case when {col} is null or {col} = '' then 'other' "
            f"when {_any(s, COMPUTE_SERVICES)} then 'compute' "
            f"when {_any(s, STORAGE_SERVICES)} then 'storage' "
            f"when {_any(s, SERVERLESS_SERVICES)} then 'serverless' "
            f"when {_any(s, DATABASE_SERVICES)} then 'database' else 'other' end)")


def flag(table: dict, service: str = "service", provider: str = "provider") -> str:
    s, p = f"lower({service})", f"lower({provider})"
    branches = " ".join(f"when {p} = '{k}' then {_any(s, v)}" for k, v in table.items())
    return (f"(case when {service} is null or {service} = '' or {provider} is null or {provider} = '' "
            f"then false else coalesce(case {branches} else false end, false) end)")


def is_compute(s="service", p="provider"):
    return flag(COMPUTE_KEYWORDS, s, p)


def is_storage(s="service", p="provider"):
    return flag(STORAGE_KEYWORDS, s, p)


def is_snapshot(s="service", p="provider"):
    return flag(SNAPSHOT_KEYWORDS, s, p)


def is_block(s="service", p="provider"):
    return flag(BLOCK_STORAGE_KEYWORDS, s, p)


def _case_map(col: str, mapping: dict, default) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)
    return "(case " + " ".join(f"when {col} = '{k}' then {lit(v)}" for k, v in mapping.items()) + \
        f" else {lit(default)} end)"


# ---------------------------------------------------------------- pipeline CTE chain
def pipeline_ctes(source: str = "billing", where: str | None = None, top_n: int = 20,
                  prefix: str = "", extra_leaks: list[str] | None = None) -> list[str]:
    """CTEs computing features, detectors, scored and primary leaks over ``source``.

    ``prefix`` lets two runs (e.g. previous vs current) live in one statement;
    ``extra_leaks`` names CTEs already in LEAK shape to add to the union (RI leaks).
    """
    p = prefix
    filt = f" where {where}" if where else ""
    ctes = [
        f"{p}norm as (select * from {source}{filt})",
        f"{p}daily0 as (select date, provider, service, sum(cost) as daily_cost from {p}norm group by all)",
        f"""{p}dailyz as (select *, (daily_cost - rolling_mean) / (rolling_std + 0.01) as z_score from (
            select *, case when count(daily_cost) over w >= 3 then avg(daily_cost) over w end as rolling_mean,
                      case when count(daily_cost) over w >= 3 then stddev_samp(daily_cost) over w end as rolling_std
            from {p}daily0
            window w as (partition by provider, service order by date rows between 7 preceding and 1 preceding)))""",
        f"""{p}svc as (select provider, service, avg(daily_cost) as avg_daily_cost, count(*) as days,
            count(distinct date) as days_present, arg_min(daily_cost, date) as first_cost,
            arg_max({{'c': daily_cost, 'z': z_score, 'm': rolling_mean}}, date) as lst,
            sum(daily_cost) as total_cost from {p}dailyz group by provider, service)""",
        f"""{p}svc2 as (select provider, service, avg_daily_cost, days, days_present, first_cost, total_cost,
            lst.c as last_cost, lst.z as last_z, lst.m as last_rolling_mean from {p}svc)""",
        f"""{p}res as (select provider, service, resource_id, count(distinct date) as days_active,
            sum(cost) as cost_sum, count(*) as nrows,
            sum(case when usage is not null then cost end) as usage_cost_sum,
            sum(usage) as usage_sum, count(usage) as usage_rows
            from {p}norm where resource_id is not null group by provider, service, resource_id)""",
        f"""{p}resf as (select provider, service, resource_id, days_active, cost_sum, nrows,
            case when usage_rows > 0 and usage_cost_sum <> 0 then usage_sum / usage_cost_sum end as ratio,
            usage_rows > 0 as has_usage, cost_sum / nrows as mean_row_cost from {p}res)""",
        # E1
        f"""{p}p25 as (select provider, service, ratio as p25 from (
            select provider, service, ratio,
                   row_number() over (partition by provider, service order by ratio) - 1 as pos,
                   count(*) over (partition by provider, service) as n
            from {p}resf where ratio is not null)
            where n >= 4 and pos = greatest(0, cast(floor(n * 0.25) as bigint) - 1))""",
        f"""{p}zombie as (select * from (
            select r.*, coalesce(q.p25, case r.provider when 'AWS' then 0.05e0 when 'AZURE' then 0.10e0 else 3.0e0 end) as threshold
            from {p}resf r left join {p}p25 q on q.provider = r.provider and q.service = r.service
            where r.ratio is not null and r.days_active >= 14) where ratio < threshold)""",
        # E2
        f"""{p}idle as (select r.*, s.avg_daily_cost from {p}resf r
            left join {p}svc2 s on s.provider = r.provider and s.service = r.service
            where {category('r.service')} = 'compute' and r.days_active >= 3 and r.ratio is not null
              and r.ratio <= 5 and coalesce(s.avg_daily_cost, 0) >= 1
              and r.resource_id not in (select resource_id from {p}zombie))""",
        # E3
        f"""{p}runaway as (select * from (
            select s.*, (s.last_cost - s.first_cost) / greatest(s.first_cost, 0.01) * 100 as growth_pct,
                   (s.last_z is not null and s.last_z >= 2.5) as z_path
            from {p}svc2 s left join (select provider, service, avg(ratio) as mean_ratio from {p}resf where has_usage
                                       group by provider, service) m
              on m.provider = s.provider and m.service = s.service
            where s.days >= 3 and s.avg_daily_cost >= 2 and not coalesce(m.mean_ratio > 10, false))
            where z_path or growth_pct >= 30)""",
        # E4
        f"""{p}always_on as (select s.*, t.total_days from {p}svc2 s,
              (select count(distinct date) as total_days from {p}dailyz) t
            where {category('s.service')} in ('compute', 'database') and s.avg_daily_cost >= 50
              and s.days_present / greatest(t.total_days, 1) >= 0.9
              and not exists (select 1 from {p}norm n where n.provider = s.provider and n.service = s.service
                              and n.labels_owner is not null))""",
        # E5
        f"""{p}rows5 as (select seq, provider, service, resource_id, date,
              case when region is not null and region <> '' then region else 'unknown' end as slot_region,
              {is_compute()} as c, {is_block()} as b
            from {p}norm where resource_id is not null and resource_id <> '')""",
        f"""{p}orphaned as (select f.resource_id, f.fst.provider as provider, f.fst.service as service,
                   f.fst.s as first_seq
            from (select resource_id, min({{'s': seq, 'provider': provider, 'service': service}}) as fst
                  from {p}rows5 where not c and b group by resource_id) f
            where f.resource_id not in (
              select distinct st.resource_id from {p}rows5 st
              join (select distinct provider, date, slot_region from {p}rows5 where c) cs
                on cs.provider = st.provider and cs.date = st.date and cs.slot_region = st.slot_region
              where not st.c and st.b))""",
        # E6
        f"""{p}idle_db as (select * from {p}resf
            where {category('service')} = 'database' and days_active >= 7 and ratio is not null
              and ratio <= 0.2 and mean_row_cost >= 10)""",
        # E7
        f"""{p}snapshot as (select f.resource_id, f.fst.provider as provider, f.fst.service as service,
                   f.fst.s as first_seq
            from (select resource_id, min({{'s': seq, 'provider': provider, 'service': service}}) as fst
                  from {p}norm where resource_id is not null and resource_id <> '' and {is_snapshot()}
                  group by resource_id) f
            where f.resource_id not in (select resource_id from {p}norm where resource_id is not null
                and resource_id <> '' and {category('service')} in ('compute', 'database')))""",
        # E8
        f"""{p}untagged_all as (select u.resource_id, u.fst.provider as provider, u.fst.service as service,
              u.fst.s as first_seq, coalesce(rt.resource_cost, 0) as resource_cost
            from (select resource_id, min({{'s': seq, 'provider': provider, 'service': service,
                                            'untagged': not (labels_owner is not null and labels_owner <> ''
                                                          and lower(labels_owner) not in ('', 'unknown', 'none', 'nan'))}})
                         as fst
                  from {p}norm where resource_id is not null and resource_id <> '' group by resource_id) u
            left join (select resource_id, sum(cost) as resource_cost from {p}norm where resource_id is not null
                       group by resource_id) rt on rt.resource_id = u.resource_id
            left join (select provider, service, sum(cost) as service_cost from {p}norm group by provider, service) st
              on st.provider = u.fst.provider and st.service = u.fst.service
            where not (coalesce(rt.resource_cost, 0) < 0.01 and coalesce(st.service_cost, 0) < 0.01)
              and u.fst.untagged)""",
        f"""{p}untagged as (select * from {p}untagged_all order by resource_cost desc, first_seq limit {int(top_n)})""",
        # union in LEAK shape
        f"""{p}leaks as (
            select 'ZOMBIE_RESOURCE' as leak_type, provider, service, resource_id,
                   'Active ' || days_active || ' days with usage-to-cost ratio of ' || {ff('ratio', 4)}
                   || ' (below service p25 threshold ' || {ff('threshold', 4)} || ')' as reason,
                   null::double as z_score, null::double as exact_waste, 1 as detector_rank,
                   null::double as order_num, null::bigint as order_seq from {p}zombie
            union all
            select 'IDLE_RESOURCE', provider, service, resource_id,
                   'Low usage detected over ' || days_active || ' days', null, null, 2, null, null from {p}idle
            union all
            select 'RUNAWAY_COST', provider, service, null,
                   case when z_path then 'Cost spike: $' || {ff('last_cost', 2)} || '/day is ' || {ff('last_z', 1)}
                        || ' stddevs above ' || case when last_rolling_mean is not null
                           then '7-day baseline of $' || {ff('last_rolling_mean', 2)} else 'recent baseline' end
                   else 'Daily cost increased from $' || {ff('first_cost', 2)} || ' to $' || {ff('last_cost', 2)}
                        || ' over ' || days || ' days (+' || {ff('growth_pct', 0)} || '%)' end,
                   case when z_path then {pr('last_z', 2)} end, null, 3, null, null from {p}runaway
            union all
            select 'ALWAYS_ON_HIGH_COST', provider, service, null,
                   'Always-on service costing $' || {ff('avg_daily_cost', 2)} || '/day with no ownership metadata',
                   null, null, 4, null, null from {p}always_on
            union all
            select 'ORPHANED_STORAGE', provider, service, resource_id,
                   'Storage resource active in regions/dates where no compute was running — likely detached or abandoned',
                   null, null, 5, null, first_seq from {p}orphaned
            union all
            select 'IDLE_DATABASE', provider, service, resource_id,
                   'Database active ' || days_active || ' days with minimal usage (ratio ' || {ff('ratio', 4)} || ')',
                   null, {money('mean_row_cost * 30')}, 6, null, null from {p}idle_db
            union all
            select 'SNAPSHOT_SPRAWL', provider, service, resource_id,
                   'Snapshot or backup generating cost with no active parent resource',
                   null, null, 7, null, first_seq from {p}snapshot
            union all
            select 'UNTAGGED_RESOURCE', provider, service, resource_id,
                   'Resource has no ownership tags (owner / project / environment missing)',
                   null, null, 8, -resource_cost, first_seq from {p}untagged"""
        + "".join(f"\n            union all select * from {x}" for x in (extra_leaks or [])) + ")",
    ]
    ctes += scoring_ctes(p)
    return ctes


def scoring_ctes(p: str = "") -> list[str]:
    weights = _case_map("leak_type", LEAK_TYPE_WEIGHTS, 0)
    bonus = " + ".join(
        f"(case when {_any('lower(coalesce(reason, ' + chr(39) * 2 + '))', words)} then {pts} else 0 end)"
        for words, pts in REASON_BONUSES)
    mult = _case_map("leak_type", WASTE_MULTIPLIERS, 0.2)
    prio = _case_map("leak_type", LEAK_PRIORITY, 0)
    ri = "'RI_SAVINGS_PLAN_WASTE', 'RI_UNUSED_RESERVATION'"
    return [
        f"""{p}dedup as (select * exclude (rn) from (select *, row_number() over (
              partition by leak_type, provider, service, resource_id
              order by detector_rank, order_num nulls first, order_seq nulls first) as rn from {p}leaks) where rn = 1)""",
        f"""{p}scored0 as (select l.*, s.avg_daily_cost, r.days_active from {p}dedup l
            left join {p}svc2 s on s.provider is not distinct from l.provider and s.service is not distinct from l.service
            left join {p}resf r on r.provider is not distinct from l.provider and r.service is not distinct from l.service
                               and r.resource_id is not distinct from l.resource_id)""",
        f"""{p}scored1 as (select *, cast(greatest(0, least(100, {weights} + {bonus}
              + (case when coalesce(days_active, 0) >= 30 then 15 when coalesce(days_active, 0) >= 14 then 8 else 0 end)
              + (case when z_score is not null and z_score > 3.0 then 15 else 0 end)
              - (case when leak_type in ('UNTAGGED_RESOURCE', 'SNAPSHOT_SPRAWL') then 5 else 0 end))) as integer) as severity_score,
              coalesce(case when exact_waste is not null and exact_waste <> 0 then exact_waste end,
                       {money('coalesce(avg_daily_cost, 0.0) * 30 * ' + mult)}) as estimated_monthly_waste,
              case when coalesce(days_active, 0) >= 14 and coalesce(avg_daily_cost, 0) > 0 then 'HIGH'
                   when coalesce(days_active, 0) >= 7 or (coalesce(avg_daily_cost, 0) > 0 and z_score is not null) then 'MEDIUM'
                   when leak_type in ({ri}) then 'HIGH' else 'LOW' end as confidence,
              {prio} as priority
            from {p}scored0)""",
        f"""{p}scored as (select *,
              case when severity_score >= 65 then 'HIGH' when severity_score >= 35 then 'MEDIUM' else 'LOW' end as severity,
              case when severity_score >= 65 then '{SEVERITY_ACTIONS['HIGH']}'
                   when severity_score >= 35 then '{SEVERITY_ACTIONS['MEDIUM']}'
                   else '{SEVERITY_ACTIONS['LOW']}' end as recommended_action,
              {money('estimated_monthly_waste * 12')} as estimated_annual_waste,
              case when resource_id is not null and resource_id <> '' then resource_id
                   else coalesce(provider, 'None') || ':' || coalesce(service, 'None') end as primary_key
            from {p}scored1)""",
        f"""{p}ranked as (select *, row_number() over (order by -severity_score, -estimated_monthly_waste, detector_rank,
              order_num nulls first, order_seq nulls first, provider nulls first, service nulls first,
              resource_id nulls first) as report_pos from {p}scored)""",
        f"""{p}primary_leaks as (select * exclude (rk, first_pos) from (
            select *, row_number() over (partition by primary_key order by -severity_score, -priority,
                     -estimated_monthly_waste, report_pos) as rk,
                   min(report_pos) over (partition by primary_key) as first_pos
            from {p}ranked) where rk = 1)""",
        f"""{p}primary_order as (select *, row_number() over (order by first_pos) as primary_pos from (
            select p.*, (select min(r.report_pos) from {p}ranked r where r.primary_key = p.primary_key) as first_pos
            from {p}primary_leaks p))""",
    ]


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


RI_LEAK_CTES = [
    """ri_sp as (select 'RI_SAVINGS_PLAN_WASTE' as leak_type, 'AWS' as provider, 'Savings Plans' as service,
        null::varchar as resource_id,
        'Unused savings plan commitment costing $' || """ + fg("total", 2) + """ || ' in this billing period' as reason,
        null::double as z_score, """ + pr("total", 2) + """ as exact_waste, 9 as detector_rank,
        null::double as order_num, null::bigint as order_seq from (
          select count(*) as n, coalesce(sum(try_cast(line_item_unblended_cost as double)), 0.0) as total from cur
          where line_item_line_item_type in ('SavingsPlanNegation', 'SavingsPlanRecurringFee'))
        where n > 0 and total >= 10)""",
    """ri_un as (select 'RI_UNUSED_RESERVATION' as leak_type, 'AWS' as provider, 'Reserved Instances' as service,
        null::varchar as resource_id,
        'Unused reserved capacity costing $' || """ + fg("t.total", 2) + """ || ' (' || d.detail || ')' as reason,
        null::double as z_score, """ + pr("t.total", 2) + """ as exact_waste, 10 as detector_rank,
        null::double as order_num, null::bigint as order_seq
        from (select count(*) as n, coalesce(sum(try_cast(reservation_unused_recurring_fee as double)), 0.0) as total
              from cur where coalesce(try_cast(reservation_unused_quantity as double), 0.0) > 0) t,
             (select string_agg(product_servicecode || ': $' || """ + fg("fee", 2) + """, ', '
                     order by fee desc, product_servicecode) as detail
              from (select product_servicecode, fee, row_number() over (order by fee desc, product_servicecode) as rk
                    from (select product_servicecode,
                                 coalesce(sum(try_cast(reservation_unused_recurring_fee as double)), 0.0) as fee
                          from cur where coalesce(try_cast(reservation_unused_quantity as double), 0.0) > 0
                            and product_servicecode is not null group by product_servicecode))
              where rk <= 3) d
        where t.n > 0 and t.total >= 10)""",
]
CUR_NORM_CTE = """cur_norm as (select seq, try_cast(line_item_usage_start_date as date) as date, 'AWS' as provider,
    product_servicecode as service, line_item_unblended_cost as cost, line_item_usage_amount as usage,
    line_item_resource_id as resource_id, product_region as region, null::varchar as labels_owner
  from cur where line_item_line_item_type is distinct from 'Tax')"""
