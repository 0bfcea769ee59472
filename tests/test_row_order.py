"""First rows by file name and position, however files are packed into tasks."""

import pytest
from pyspark.sql import functions as F

from costsieve.plans.pipeline import analyze, with_seq
from costsieve.sources import landing as L

HEADER = "line_item_usage_start_date,product_servicecode,line_item_unblended_cost,line_item_usage_amount,line_item_resource_id,line_item_line_item_type"


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def lines(n, first):
    return [f"2024-03-{i % 28 + 1:02d},AmazonEC2,1.0,1,i-{first + i},Usage" for i in range(n)]


def zone(tmp_path):
    """Two files of unlike sizes; b holds more rows, a comes first by name."""
    (tmp_path / "a x.csv").write_text("\n".join([HEADER, *lines(400, 0)]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, *lines(900, 5000)]) + "\n")
    return str(tmp_path)


def order(df):
    rows = with_seq(df).select("seq", "line_item_resource_id").orderBy("seq").collect()
    assert len({r.seq for r in rows}) == len(rows)
    return [r[1] for r in rows]


EXPECTED = [f"i-{i}" for i in range(400)] + [f"i-{5000 + i}" for i in range(900)]


@pytest.mark.parametrize("size", ["128m", "30000", "7000", "2000"])
def test_order_of_csv_rows(spark, tmp_path, split_size, size):
    split_size(size)
    assert order(L.read_csv_export(spark, zone(tmp_path))) == EXPECTED


@pytest.mark.parametrize("size", ["128m", "5000"])
def test_order_of_parquet_rows(spark, tmp_path, split_size, size):
    for name, first, n in (("a", 0, 400), ("b", 5000, 900)):
        df = spark.createDataFrame([(f"i-{first + i}",) for i in range(n)], "line_item_resource_id string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / f"z/k={name}"))
    split_size(size)
    found = order(spark.read.parquet(str(tmp_path / "z")).drop("k"))
    assert found == EXPECTED


def test_rows_without_files_and_own_order(spark):
    assert with_seq(spark.range(10)).select("seq").distinct().count() == 10
    assert with_seq(spark.range(3).withColumn("seq", F.lit(7))).select("seq").distinct().count() == 1


@pytest.mark.parametrize("size", ["128m", "20000", "3000"])
def test_the_first_files_row_decides(spark, tmp_path, split_size, size):
    """One snapshot resource under two services: the finding names the service of the first file's row."""
    row = "2024-03-{:02d},{},9.0,1,snap-1,Usage"
    (tmp_path / "a.csv").write_text("\n".join([HEADER, row.format(3, "EBS Snapshot"), *lines(300, 0)]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, row.format(1, "Backup Snapshot"), *lines(900, 5000)]) + "\n")
    split_size(size)
    found = analyze(L.read_csv_export(spark, str(tmp_path)), "AWS")
    leak = found.leaks.where("leak_type = 'SNAPSHOT_SPRAWL' and resource_id = 'snap-1'").collect()
    found.close()
    assert [r.service for r in leak] == ["EBS Snapshot"]
