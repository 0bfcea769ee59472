"""Driver contract: entry(), queries(), oracle_sql(); a sample of queries vs DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from costsieve.sources.tables import TABLES
from oracle_check import frame_hash

SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN"}
SAMPLE = ["daily_cost", "leak_runaway", "leak_idle", "leak_orphaned_storage", "forecast_30d", "cur_aggregate",
          "leak_unused_ri", "primary_leaks", "summary", "detect_file_kind", "severity_rollup"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["leak_type", "provider", "service", "resource_id"]


def test_every_query_has_an_oracle():
    from costsieve.plans.catalog import ORACLE, QUERIES

    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = entry_mod.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    srows, orows = [tuple(r) for r in sdf.collect()], cur.fetchall()
    assert len(srows) == len(orows)
    assert frame_hash(srows, sdf.columns)[0] == frame_hash(orows, ocols)[0]
    rel = con.sql(entry_mod.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    assert {f.name: SPARK_TO_DUCK.get(str(f.dataType)) for f in sdf.schema.fields} == duck_types
