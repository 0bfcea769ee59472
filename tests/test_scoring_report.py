"""Scoring against a plain-Python model, pipeline invariants, reports, enrichment, payloads."""

import json
import random

from pyspark.sql import functions as F

from costsieve import schema as S
from costsieve.operators import enrich as G
from costsieve.operators import report as H
from costsieve.operators import scoring as Fs
from costsieve.plans.pipeline import analyze
from costsieve.sources import payloads as A
from costsieve.sources.tables import billing
from conftest import SF_SMALL

REASONS = ["Low usage detected over 30 days", "Cost spike: $1.00/day is 4.0 stddevs above recent baseline",
           "Snapshot or backup generating cost", "no ownership metadata", "Active 130 days with x", "plain"]


def model(leak, days, avg):
    """F2–F5 written from the rules, independent of the Spark code."""
    r = leak["reason"].lower()
    score = S.LEAK_TYPE_WEIGHTS.get(leak["leak_type"], 0)
    for words, pts in S.REASON_BONUSES:
        if any(w in r for w in words):
            score += pts
    score += 15 if days >= 30 else 8 if days >= 14 else 0
    if leak["z_score"] is not None and leak["z_score"] > 3.0:
        score += 15
    if leak["leak_type"] in ("UNTAGGED_RESOURCE", "SNAPSHOT_SPRAWL"):
        score -= 5
    score = max(0, min(100, score))
    sev = "HIGH" if score >= 65 else "MEDIUM" if score >= 35 else "LOW"
    if leak["exact_waste"]:
        monthly = leak["exact_waste"]
    else:
        monthly = round(avg * 30 * S.WASTE_MULTIPLIERS.get(leak["leak_type"], 0.2), 2)
    if days >= 14 and avg > 0:
        conf = "HIGH"
    elif days >= 7 or (avg > 0 and leak["z_score"] is not None):
        conf = "MEDIUM"
    elif leak["leak_type"] in S.RI_TYPES:
        conf = "HIGH"
    else:
        conf = "LOW"
    return score, sev, monthly, conf


def test_scoring_matches_model(spark):
    rnd = random.Random(11)
    leaks, services, lifes = [], [], []
    for i in range(200):
        lt = rnd.choice(list(S.LEAK_TYPE_WEIGHTS))
        z = rnd.choice([None, 2.0, 3.5])
        ex = rnd.choice([None, 0.0, 123.45])
        leaks.append((lt, "AWS", f"s{i % 5}", f"r{i}", rnd.choice(REASONS), z, ex, 1, None, None))
        lifes.append(("AWS", f"s{i % 5}", f"r{i}", rnd.choice([0, 5, 7, 14, 29, 30, 90])))
    for j in range(5):
        services.append(("AWS", f"s{j}", rnd.choice([0.0, 0.37, 12.5, 250.0])))
    ldf = spark.createDataFrame(leaks, S.LEAK)
    sdf = spark.createDataFrame(services, "provider string, service string, avg_daily_cost double")
    rdf = spark.createDataFrame(lifes, "provider string, service string, resource_id string, days_active long")
    got = {r["resource_id"]: r for r in Fs.score_leaks(ldf, sdf, rdf).collect()}
    avg = {s: a for _, s, a in services}
    days = {r: d for _, _, r, d in lifes}
    for lt, p, s, r, reason, z, ex, *_ in leaks:
        want = model(dict(leak_type=lt, reason=reason, z_score=z, exact_waste=ex), days[r], avg[s])
        g = got[r]
        assert (g["severity_score"], g["severity"], g["estimated_monthly_waste"], g["confidence"]) == want
        assert g["estimated_annual_waste"] == round(want[2] * 12, 2)


def test_pipeline_invariants_and_delta(spark, tmp_path):
    a = analyze(billing(spark, SF_SMALL), already_normalized=True)
    scored = {(r.leak_type, r.provider, r.service, r.resource_id) for r in a.scored.collect()}
    primary = a.primary.collect()
    assert {(r.leak_type, r.provider, r.service, r.resource_id) for r in primary} <= scored
    assert len({r.primary_key for r in primary}) == len(primary)
    assert a.leaks.count() == Fs.dedupe_leaks(a.leaks).count()       # dedupe is idempotent
    counts = dict(a.leaks.groupBy("leak_type").count().collect())
    assert counts.get("RUNAWAY_COST") == 9 and counts.get("IDLE_RESOURCE") == 15     # FIXTURES.md sf0.001
    assert counts.get("ORPHANED_STORAGE") == 4 and counts.get("IDLE_DATABASE") == 7
    assert counts.get("SNAPSHOT_SPRAWL") == 7 and "ZOMBIE_RESOURCE" not in counts
    assert a.forecasts.count() == 13
    snap = str(tmp_path / "ids")
    first = H.apply_delta(a.primary, H.load_previous_ids(spark, str(tmp_path / "missing")))
    assert {r.status for r in first.collect()} == {"NEW"}
    H.save_current_ids(a.primary, snap)
    second = H.apply_delta(a.primary, H.load_previous_ids(spark, snap))
    assert {r.status for r in second.collect()} == {"EXISTING"}
    s = H.report_summary(second).first()
    assert s.new_leaks == 0 and s.total_leaks == len(primary)
    table = H.report_table(second).orderBy("row_no").collect()
    assert [r.row_no for r in table] == list(range(1, len(primary) + 1))
    assert all(len(r.resource) <= 30 for r in table)


def test_insights_healthy_line(spark):
    empty = spark.createDataFrame([], "severity string, leak_type string, provider string, service string, "
                                      "resource_id string, reason string, recommended_action string")
    assert [r[0] for r in H.insights(empty).collect()] == [H.HEALTHY_INSIGHT]


def test_enrichment_parse_and_attach(spark):
    leaks = spark.createDataFrame([
        ("RUNAWAY_COST", "AWS", "ec2", None, "HIGH", 1), ("IDLE_RESOURCE", "AWS", "ec2", "i-1", "LOW", 2),
        ("ZOMBIE_RESOURCE", "AWS", "ec2", "i-2", "MEDIUM", 3)],
        "leak_type string, provider string, service string, resource_id string, severity string, first_key int")
    c = G.enrich_candidates(leaks, n=10)
    assert [r.leak_type for r in c.collect()] == ["RUNAWAY_COST", "ZOMBIE_RESOURCE"]
    good = json.dumps({"root_cause": "x", "fix_command": "y", "estimated_remediation_minutes": 5,
                       "risk_level": "LOW", "risk_note": "n", "priority_reason": "p"})
    replies = spark.createDataFrame([
        ("RUNAWAY_COST", "AWS", "ec2", None, "```json\n" + good + "\n```"),
        ("ZOMBIE_RESOURCE", "AWS", "ec2", "i-2", "sorry, no json")],
        "leak_type string, provider string, service string, resource_id string, reply string")
    att = {r.leak_type: r.llm_recommendation for r in
           G.attach_recommendations(leaks, G.parse_recommendations(replies)).collect()}
    assert att["RUNAWAY_COST"]["estimated_remediation_minutes"] == 5
    assert att["ZOMBIE_RESOURCE"] is None and att["IDLE_RESOURCE"] is None


def test_api_payload_flattening(spark, tmp_path):
    aws = {"ResultsByTime": [{"TimePeriod": {"Start": "2024-01-01", "End": "2024-01-02"}, "Groups": [
        {"Keys": ["AmazonEC2"], "Metrics": {"BlendedCost": {"Amount": "12.5"}, "UsageQuantity": {"Amount": "3"}}},
        {"Keys": ["AmazonS3"], "Metrics": {"BlendedCost": {"Amount": "0"}}},
        {"Keys": ["AWSLambda"], "Metrics": {"BlendedCost": {"Amount": "1.25"}}}]}]}
    (tmp_path / "aws.json").write_text(json.dumps(aws))
    flat = A.flatten_aws_cost_explorer(A.read_aws_pages(spark, str(tmp_path / "aws.json")), "us-east-1")
    assert sorted((r.service, r.cost, r.usage) for r in flat.collect()) == [("AWSLambda", 1.25, 0.0),
                                                                          ("AmazonEC2", 12.5, 3.0)]
    az = {"columns": [{"name": "Cost"}, {"name": "UsageDate"}, {"name": "ServiceName"}],
          "rows": [[4.5, 20240101, "Storage"], [None, 20240102, "VM"], [2.0, "2024-01-03", "VM"], [1.0, 20240104, "VM"]]}
    (tmp_path / "az.json").write_text(json.dumps(az))
    out = A.flatten_azure_query(A.read_azure_pages(spark, str(tmp_path / "az.json"))).orderBy("date").collect()
    assert [(str(r.date), r.service, r.cost) for r in out] == [("2024-01-01", "Storage", 4.5), ("2024-01-04", "VM", 1.0)]


def test_sanitize_and_currency(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert [r.x for r in H.sanitize_frame(df).collect()] == [1.0, None, None]
    m = spark.createDataFrame([(100.0,)], "m double")
    got = {c: H.convert_currency(m, c, ["m"]).first() for c in ("USD", "EUR", "INR")}
    assert {c: (r.currency, r.m) for c, r in got.items()} == {"USD": ("USD", 100.0), "EUR": ("EUR", 92.0), "INR": ("INR", 8350.0)}
    assert H.filter_severity(spark.createDataFrame([("HIGH",), ("LOW",)], "severity string"), "high").count() == 1


def test_primary_selection_matches_model(spark):
    """F7 against a plain-Python model: best leak per key by (score, type priority, waste),
    keys listed in the order of their first leak in the scored report order."""
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        lt = rnd.choice(list(S.LEAK_PRIORITY))
        rid = rnd.choice([None, "", f"r{rnd.randint(0, 40)}"])
        rows.append((lt, "AWS", f"s{rnd.randint(0, 3)}", rid, "x", None, None, S.DETECTOR_RANK[lt],
                     None, i, rnd.choice([10, 30, 45, 65, 80]), float(rnd.choice([0, 5, 12.5, 99]))))
    # one leak per (type, provider, service, resource) as after dedupe
    seen, uniq = set(), []
    for r in rows:
        if r[:4] not in seen:
            seen.add(r[:4])
            uniq.append(r)
    from pyspark.sql import types as T

    schema = T.StructType(S.LEAK.fields + [T.StructField("severity_score", T.IntegerType()),
                                           T.StructField("estimated_monthly_waste", T.DoubleType())])
    df = spark.createDataFrame(uniq, schema)
    df = df.withColumn("rank_key", Fs.rank_key())
    got = [(r.leak_type, r.service, r.resource_id) for r in Fs.select_primary(df).orderBy("first_key").collect()]

    def order(r):  # report order: score desc, waste desc, detector order
        return (-r[10], -r[11], r[7], r[9], r[1], r[2], r[3] or "")
    scored = sorted(uniq, key=order)
    groups = {}
    for r in scored:
        key = r[3] or f"{r[1]}:{r[2]}"
        groups.setdefault(key, []).append(r)
    want = []
    for key, leaks in groups.items():       # dict keeps first-appearance order
        best = sorted(leaks, key=lambda r: (-r[10], -S.LEAK_PRIORITY[r[0]], -r[11]))[0]
        want.append((best[0], best[2], best[3]))
    assert got == want
