"""Distributed ranks, quantiles and the statistical features against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from costsieve.operators import features as D
from costsieve.operators import explore as I
from costsieve.operators.ranking import average_rank_pct, global_positions, kth_smallest, row_slices


def test_average_rank_matches_pandas_on_a_hot_group(spark):
    rnd = random.Random(7)
    # one group holds most rows (the "hot key"), with many ties
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)] + \
           [(f"g{i % 7}", float(rnd.randint(0, 5))) for i in range(300)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double")
    got = {r["id"]: r["pct"] for r in average_rank_pct(df, ["g"], "v").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    want = pdf.groupby("g")["v"].rank(pct=True)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(len(rows)))


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_ranks_of_a_value_over_several_slices(spark, slices):
    rnd = random.Random(slices)
    special = [None, float("nan"), 0.0, -0.0, float("inf")]
    rows = [(g, 1.5 if rnd.random() < 0.5 else rnd.choice([*special, float(rnd.randrange(40))]))
            for g in ["hot"] * 900 + ["cold"] * 30 + [None] * 25] + [("same", 2.0)] * 200 + [("nulls", None)] * 3 + [("one", 4.0)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double")
    got = {r["id"]: r["pct"] for r in average_rank_pct(df, ["g"], "v", slices=slices).collect()}
    assert len(got) == len(rows)
    place = lambda v: (1, 0.0) if v != v else (0, v)  # noqa: E731  NaN equals NaN and is the largest
    for i, (g, v) in enumerate(rows):
        if v is None:
            assert got[i] is None
            continue
        same = [place(x) for h, x in rows if h == g and x is not None]
        lt, eq = sum(x < place(v) for x in same), sum(x == place(v) for x in same)
        assert got[i] == (lt + (eq + 1) / 2.0) / len(same)


def test_repeated_rows_and_empty_tables_have_ranks(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("a", 2.0)], "g string, v double")
    assert sorted(r["pct"] for r in average_rank_pct(df, ["g"], "v", slices=2).collect()) == [0.5] * 4 + [1.0]
    assert average_rank_pct(df.limit(0), ["g"], "v").count() == 0


def test_a_cost_of_half_of_all_rows_is_spread(spark):
    df = spark.range(20_000).select("id", F.lit("s").alias("g"), F.when(F.col("id") % 2 == 0, 7.25).otherwise(F.col("id") * 0.5).alias("v"))
    sizes = [r["count"] for r in row_slices(df, ["g"], "v", slices=16).groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2.5 * 20_000 / 16
    plan = average_rank_pct(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "v#" in line for line in plan.splitlines())


def test_kth_smallest_and_global_positions(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0, 2.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in vals], "g string, v double")
    got = kth_smallest(df, ["g"], "v", lambda n: F.greatest(F.lit(0), F.floor(n * 0.25).cast("long") - 1)).first()
    assert got["v"] == sorted(vals)[max(0, int(len(vals) * 0.25) - 1)]
    pos = global_positions(df.withColumn("i", F.monotonically_increasing_id()), [F.col("v"), F.col("i")], "p")
    assert [r["v"] for r in pos.orderBy("p").collect()] == sorted(vals)


@pytest.mark.parametrize("exact_rows", [50_000, 40])
def test_bracketed_quantile_matches_numpy(spark, monkeypatch, exact_rows):
    monkeypatch.setattr(I, "EXACT_ROWS", exact_rows)
    rnd = random.Random(3)
    for vals in ([rnd.random() * 100 for _ in range(1001)], [float(rnd.randrange(4)) for _ in range(500)], [2.0] * 90 + [1.0, 7.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in vals + [None, float("nan")]], "v double")
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert I.bracketed_quantile(df, "v", q) == pytest.approx(float(np.quantile(vals, q)), abs=1e-9)
    assert I.bracketed_quantile(df.limit(0), "v", 0.5) is None


@pytest.mark.parametrize("heavy", [([0.0] * 300, [9.0] * 300), ([0.0] * 900, []), ([], [9.0] * 900), ([0.0] * 400 + [0.5] * 350, [9.0] * 300)])
def test_quantile_between_heavy_ends_collects_few(spark, monkeypatch, heavy):
    """Heavy end values can't stop the bracket from narrowing to EXACT_ROWS values."""
    monkeypatch.setattr(I, "EXACT_ROWS", 20)
    rnd = random.Random(8)
    vals = heavy[0] + [1 + 7 * rnd.random() for _ in range(400)] + heavy[1]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    edges = [len(heavy[0]) / (len(vals) - 1), (len(heavy[0]) + 399.5) / (len(vals) - 1)]
    for q in (0.0, 0.45, 0.55, 1.0, *[e - 0.5 / (len(vals) - 1) for e in edges if 0 < e <= 1]):
        assert I.bracketed_quantile(df, "v", max(q, 0.0)) == pytest.approx(float(np.quantile(vals, max(q, 0.0))), abs=1e-9)


def test_zscore_matches_pandas_rolling(spark):
    costs = [10, 12, 9, 11, 30, 10, 10, 11, 12, 50, 9, 8]
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=len(costs)).date,
                        "provider": "AWS", "service": "ec2", "daily_cost": [float(c) for c in costs]})
    shifted = pdf["daily_cost"].shift(1)
    mean, std = shifted.rolling(7, min_periods=3).mean(), shifted.rolling(7, min_periods=3).std()
    want = ((pdf["daily_cost"] - mean) / (std + 0.01)).tolist()
    got = [r["z_score"] for r in D.cost_zscore(spark.createDataFrame(pdf)).orderBy("date").collect()]
    for a, b in zip(got, want):
        assert (a is None and np.isnan(b)) or abs(a - b) < 1e-9


def test_forecast_matches_numpy(spark):
    y = [10.0 + 0.5 * i + (i % 3) for i in range(40)]
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=40).date, "provider": "AWS",
                        "service": "ec2", "daily_cost": y})
    r = D.forecast_30d(spark.createDataFrame(pdf)).first()
    slope, intercept = np.polyfit(np.arange(40.0), np.array(y), 1)
    monthly = round((intercept + slope * 70) * 30, 2)
    actual = round(float(np.mean(y[-30:])) * 30, 2)
    monthly = round(min(monthly, max(actual, 0.01) * 3), 2)
    assert r["projected_monthly_cost"] == monthly and r["last_30d_actual"] == actual
    assert r["trend_pct"] == round(max(-150.0, min(150.0, (monthly - actual) / max(actual, 0.01) * 100)), 1)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from costsieve.operators.ranking import value_ranks  # noqa: E402

_rows = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.integers(min_value=0, max_value=6)),
    min_size=1, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=_rows, slices=st.integers(min_value=1, max_value=9))
def test_value_ranks_property(spark, rows, slices):
    """lt / eq / n per distinct (group, value) equal brute-force counts, for any slicing,
    with a hot group, heavy ties and a null group key."""
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    got = {(r.g, r.v): (r.lt, r.eq, r.n) for r in value_ranks(df, ["g"], "v", slices=slices).collect()}
    want = {}
    for g, v in set(rows):
        same = [x for gg, x in rows if gg == g]
        want[(g, float(v))] = (sum(x < v for x in same), sum(x == v for x in same), len(same))
    assert got == want


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(vals=st.lists(st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.sampled_from([2.675, 0.125, 1.005, 2.5, -2.5, 1234567.125, 0.0, -0.001])), min_size=1, max_size=200))
def test_python_rounding_and_formatting(spark, vals):
    """py_round / fmt_fixed / fmt_grouped equal Python's round() and format specs."""
    from costsieve.functions import fmt_fixed, fmt_grouped, py_round

    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, x double")
    rows = df.select("i", py_round("x", 2).alias("r2"), fmt_fixed("x", 4).alias("f4"),
                     fmt_grouped("x", 2).alias("g2"), fmt_fixed("x", 0).alias("f0")).collect()
    for r in rows:
        x = vals[r.i]
        assert r.r2 == round(x, 2) + 0.0
        assert r.f4 == f"{x:.4f}" and r.g2 == f"{x:,.2f}" and r.f0 == f"{x:.0f}"
