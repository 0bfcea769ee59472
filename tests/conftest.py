import datetime as dt
import os
import sys

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.abspath(__file__)))

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from costsieve.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


UNIFIED = ("seq long, date date, provider string, service string, cost double, usage double, "
           "resource_id string, region string")


def unified(spark, rows, owner=False):
    """rows: dicts with defaults date 2024-03-01, AWS, cost 1.0, usage 1.0, res-001, us-east-1."""
    base = dict(date=dt.date(2024, 3, 1), provider="AWS", service="ec2", cost=1.0, usage=1.0,
                resource_id="res-001", region="us-east-1")
    out = []
    for i, r in enumerate(rows):
        x = {**base, **r}
        t = (i, x["date"], x["provider"], x["service"], x["cost"], x["usage"], x["resource_id"], x["region"])
        out.append(t + ((x.get("labels_owner"),) if owner else ()))
    schema = UNIFIED + (", labels_owner string" if owner else "")
    return spark.createDataFrame(out, schema)


def days(n, start=dt.date(2024, 3, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]
