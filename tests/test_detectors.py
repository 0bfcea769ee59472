"""Detector rules (E1–E10) around their thresholds: just below, equal, just above.

Each case is a service or a resource of its own in one table, so a rule's boundary is one run.
"""

import pytest
from conftest import days, unified

from costsieve import schema as S
from costsieve.operators import detectors as E
from costsieve.plans.pipeline import build_features


def feats(spark, rows, owner=False):
    return build_features(unified(spark, rows, owner), materialize=False)


def names(df, col="resource_id"):
    return {r[0] for r in df.select(col).collect()}


def series(n, **row):
    return [dict(date=d, **row) for d in days(n)]


# ---------------------------------------------------------------- E1 zombie
def test_zombie_age_and_fallback_ratio(spark):
    rows = []
    for service, age, ratio in [("ec2 a", 13, 0.001), ("ec2 b", 14, 0.001), ("ec2 c", 14, 0.0499), ("ec2 d", 14, 0.05), ("ec2 e", 40, 0.06)]:
        rows += series(age, service=service, resource_id=service[-1], cost=64.0, usage=64.0 * ratio)
    rows += series(15, service="Virtual Machines", provider="AZURE", resource_id="az", cost=64.0, usage=64.0 * 0.07)
    rows += series(15, service="Compute Engine", provider="GCP", resource_id="gc", cost=64.0, usage=64.0 * 2.5)
    assert names(E.detect_zombie(feats(spark, rows).resources)) == {"b", "c", "az", "gc"}


@pytest.mark.parametrize("n,found", [(3, {"r0"}), (4, set()), (7, set()), (8, {"r0"}), (12, {"r0", "r1"})])
def test_zombie_percentile_rank(spark, n, found):
    """The threshold is the value at index max(0, int(n / 4) - 1); below it is strict. With three
    resources the fallback of 0.05 holds."""
    rows = [r for i in range(n) for r in series(16, resource_id=f"r{i}", cost=32.0, usage=32.0 * (0.03 + 0.25 * i))]
    out = E.detect_zombie(feats(spark, rows).resources)
    assert names(out) == found
    if n == 12:
        assert out.select("threshold").first()[0] == pytest.approx(0.53)


# ---------------------------------------------------------------- E2 idle
def test_idle_boundaries(spark):
    rows = series(2, service="ec2 a", resource_id="two days", cost=8.0, usage=1.0)
    rows += series(3, service="ec2 b", resource_id="three days", cost=8.0, usage=1.0)
    rows += series(4, service="ec2 c", resource_id="ratio five", cost=2.0, usage=10.0)
    rows += series(4, service="ec2 d", resource_id="ratio above", cost=2.0, usage=10.25)
    rows += series(4, service="ec2 e", resource_id="mean one", cost=1.0, usage=0.5)
    rows += series(4, service="ec2 f", resource_id="mean below", cost=0.96875, usage=0.5)
    rows += series(4, service="AmazonS3", resource_id="storage", cost=8.0, usage=1.0)
    rows += series(17, service="ec2 g", resource_id="zombie", cost=8.0, usage=0.125)
    ft = feats(spark, rows)
    zombies = E.detect_zombie(ft.resources)
    assert names(E.detect_idle(ft.resources, ft.services, zombies.select("resource_id"))) == {"three days", "ratio five", "mean one"}
    assert "zombie" in names(E.detect_idle(ft.resources, ft.services, None))


# ---------------------------------------------------------------- E3 runaway
def costs(service, values, usage=1.0):
    return [dict(date=d, service=service, resource_id=service, cost=float(c), usage=usage) for d, c in zip(days(len(values)), values)]


def test_runaway_boundaries(spark):
    rows = costs("two days", [10, 100]) + costs("three days", [10, 11, 100])
    rows += costs("mean two", [1.5, 2.0, 2.5]) + costs("mean below", [1.5, 1.9375, 2.5])
    rows += costs("growth 30", [20, 22, 26]) + costs("growth below", [20, 22, 25.5]) + costs("falling", [26, 22, 20])
    rows += costs("from nothing", [0, 3, 6])
    rows += costs("busy", [20, 24, 40], usage=1000.0) + costs("ratio ten", [20, 20, 40], usage=800 / 3)
    rows += costs("spike", [40] * 9 + [43], usage=4.0) + costs("no spike", [40] * 9 + [40.02], usage=4.0)
    ft = feats(spark, rows)
    out = {r.service: r for r in E.detect_runaway(ft.services, ft.resources).collect()}
    assert set(out) == {"three days", "mean two", "growth 30", "from nothing", "ratio ten", "spike"}
    assert out["growth 30"].reason == "Daily cost increased from $20.00 to $26.00 over 3 days (+30%)" and out["growth 30"].z_score is None
    assert (out["spike"].path, out["growth 30"].path) == ("z", "growth")
    assert out["spike"].reason == "Cost spike: $43.00/day is 300.0 stddevs above 7-day baseline of $40.00" and out["spike"].z_score == 300.0


# ---------------------------------------------------------------- E4 always-on
def test_always_on_boundaries(spark):
    rows = series(20, service="ec2 a", resource_id="a", cost=50.0) + series(20, service="ec2 b", resource_id="b", cost=49.96875)
    rows += series(18, service="ec2 c", resource_id="c", cost=64.0) + series(17, service="ec2 d", resource_id="d", cost=64.0)
    rows += series(20, service="AmazonRDS", resource_id="e", cost=64.0) + series(20, service="AmazonS3", resource_id="f", cost=64.0)
    rows += series(20, service="ec2 g", resource_id="g", cost=64.0) + [dict(date=days(1)[0], service="ec2 g", cost=64.0, labels_owner="crew")]
    ft = feats(spark, rows, owner=True)
    assert names(E.detect_always_on(ft.daily, ft.services), "service") == {"ec2 a", "ec2 c", "AmazonRDS"}


# ---------------------------------------------------------------- E5 orphaned storage, E7 snapshots
def test_orphaned_storage_and_snapshots(spark):
    rows = [
        dict(service="AmazonEBS", resource_id="near", region="x"), dict(service="AmazonEC2", resource_id="vm", region="x"),
        dict(service="AmazonEBS", resource_id="far", region="y"), dict(service="AmazonEBS", resource_id="", region="z"),
        dict(service="AmazonEBS", resource_id=None, region="z"), dict(service="AmazonS3", resource_id="bucket", region="z"),
        dict(service="EBS Snapshot", resource_id="alone", region="x"), dict(service="EBS Snapshot", resource_id="vm", region="x"),
        dict(service="EBS Snapshot", resource_id=None, region="x"), dict(service="AmazonRDS", resource_id="base", region="x"),
        dict(service="Backup", provider="AZURE", resource_id="base", region="x"), dict(service="Backup", provider="AZURE", resource_id="copy", region="x"),
    ]
    slots = feats(spark, rows).slots
    assert names(E.detect_orphaned_storage(slots)) == {"far"}
    assert names(E.detect_snapshot_sprawl(slots)) == {"alone", "copy"}


# ---------------------------------------------------------------- E6 idle database
def test_idle_database_boundaries(spark):
    rows = []
    for name, age, ratio, cost in [("young", 6, 0.125, 16.0), ("week", 7, 0.125, 16.0), ("ratio", 9, 0.1875, 16.0), ("used", 9, 0.25, 16.0),
                                   ("ten", 9, 0.125, 10.0), ("cheap", 9, 0.125, 9.96875)]:
        rows += series(age, service="AmazonRDS", resource_id=name, cost=cost, usage=cost * ratio)
    rows += series(9, service="AmazonEC2", resource_id="compute", cost=16.0, usage=1.0)
    out = {r.resource_id: r for r in E.detect_idle_database(feats(spark, rows).resources).collect()}
    assert set(out) == {"week", "ratio", "ten"} and out["week"].exact_waste == 480.0


# ---------------------------------------------------------------- E8 untagged
def test_untagged_order_and_owner_values(spark):
    rows = [dict(resource_id=f"n{i}", cost=3.5 + i % 3) for i in range(7)]
    owners = [("crew", False), ("Unknown", True), ("NONE", True), ("nan", True), ("", True), (" ", False)]
    rows += [dict(resource_id=f"o{i}", cost=900.0 + i, labels_owner=o) for i, (o, _) in enumerate(owners)]
    ft = feats(spark, rows, owner=True)
    out = [r.resource_id for r in E.detect_untagged(ft.slots, ft.services, top_n=7).orderBy("order_num", "order_seq").collect()]
    assert out == [f"o{i}" for i in (4, 3, 2, 1)] + ["n2", "n5", "n1"]  # ties: first seen
    assert len(names(E.detect_untagged(ft.slots, ft.services))) == 11 and S.UNTAGGED_TOP_N == 20


# ---------------------------------------------------------------- E9 / E10 commitments
RAW = ("line_item_line_item_type string, line_item_unblended_cost string, product_servicecode string, "
       "reservation_unused_quantity string, reservation_unused_recurring_fee string")


@pytest.mark.parametrize("total,n", [("9.99", 0), ("10", 1), ("10.01", 1)])
def test_commitment_thresholds(spark, total, n):
    raw = spark.createDataFrame([("SavingsPlanRecurringFee", total, "AmazonEC2", "0", "50"), ("Usage", "70", "AmazonEC2", "2", total),
                                 ("SavingsPlanNegation", "x", None, None, None)], RAW)
    assert E.detect_savings_plan(raw).count() == n and E.detect_unused_reservation(raw).count() == n
    if n:
        assert E.detect_savings_plan(raw).first().exact_waste == float(total)


def test_commitment_reason_names_three_services(spark):
    rows = [("Usage", "1", s, "1", f) for s, f in [("AmazonS3", "800"), ("AmazonRDS", "1500.5"), ("AmazonRDS", "200"), ("AWSLambda", "800"), ("AmazonEC2", "31")]]
    out = E.detect_unused_reservation(spark.createDataFrame([*rows, ("Usage", "1", None, "3", "7"), ("Usage", "1", "AmazonSQS", "-1", "9000")], RAW)).first()
    assert out.reason == "Unused reserved capacity costing $3,338.50 (AmazonRDS: $1,700.50, AWSLambda: $800.00, AmazonS3: $800.00)"
    assert E.detect_savings_plan(spark.createDataFrame([], RAW)).count() == 0
    assert E.detect_savings_plan(spark.createDataFrame([(1,)], "other int")).count() == 0
