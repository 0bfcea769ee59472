"""Landing zone: quoted line breaks, heads of CSV and Parquet files, row counts by reader and footer."""

import pytest
from pyspark.sql import functions as F

from costsieve.operators import detect as B
from costsieve.operators import normalize as N
from costsieve.sources import landing as L

HEADER = "UsageDate,ServiceName,CostInUSD,Tags,ResourceId"
AZURE = "\n".join([HEADER, '2024-03-01,VM,1.5,"Owner=a', 'Project=b",r1', "2024-03-02,VM,2.5,Owner=c,r2", ""])
LAST = r"([^/]+)$"


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", ["128m", "40"])
def test_fields_with_line_breaks(spark, tmp_path, split_size, size):
    """The same rows whether the file is larger than a split or not; reader and counter agree."""
    (tmp_path / "a.csv").write_text(AZURE)
    split_size(size)
    raw = L.load_export(spark, str(tmp_path / "a.csv"))
    rows = N.normalize(raw, "azure").orderBy("date").select("labels_owner", "labels_project", "cost", "resource_id").collect()
    assert [tuple(r) for r in rows] == [("a\nProject=b", "b", 1.5, "r1"), ("c", None, 2.5, "r2")]
    assert {r.rows for r in L.file_row_counts(spark, str(tmp_path)).collect()} == {2} == {raw.count()}


def test_large_files_without_line_breaks_stay_splittable(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *[f'2024-03-01,"VM ""x"", {i}",1,,r' for i in range(50)]]) + "\n")
    split_size("100")
    assert not L.holds_line_breaks(spark, str(tmp_path))
    raw = L.read_csv_export(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() > 1 and raw.count() == 50
    assert raw.where(F.col("ServiceName") == 'VM "x", 7').count() == 1
    assert L.file_row_counts(spark, str(tmp_path)).first().rows == 50


def test_heads_of_every_kind_of_file(spark, tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.csv").write_bytes(b"\xef\xbb\xbf\n\"usage\ndate\",cost\n1,2\n")
    (tmp_path / "plain/B.CSV").write_text("project_id")  # a header alone, without a line end
    (tmp_path / "plain/empty.csv").write_text("")  # Spark lists no files without content
    (tmp_path / "plain/broken.parquet").write_text("not a parquet file")
    (tmp_path / "plain/notes.txt").write_text("cost\n1\n")
    df = spark.createDataFrame([(1, 2.0, (3,))], "`line_item_line_item_type` int, `Cost.x` double, s struct<t:int>")
    df.union(df).coalesce(1).write.parquet(str(tmp_path / "deep/er/zone"))
    heads = L.file_heads(spark, str(tmp_path))
    found = {r[0].rsplit("/", 1)[1].split("-")[0]: r for r in heads.select("file", "format", "rows", "columns", "error").collect()}
    assert set(found) == {"a.csv", "B.CSV", "broken.parquet", "part"}
    assert found["a.csv"]["columns"] == ["usage\ndate", "cost"] and found["B.CSV"]["columns"] == ["project_id"]
    assert not found["broken.parquet"]["columns"] and found["broken.parquet"]["error"]
    assert found["part"]["columns"] == ["line_item_line_item_type", "Cost.x", "s"] and found["part"]["rows"] == 2
    headers = L.headers_of(heads).withColumnRenamed("file", "source")
    name = F.regexp_extract("source", LAST, 1)
    providers = {r[0].split("-")[0]: r[1] for r in B.detect_provider_files(headers).select(name, "provider").collect()}
    assert providers == {"a.csv": None, "B.CSV": "GCP", "broken.parquet": None, "part": "AWS"}
    rows = L.file_row_counts(spark, str(tmp_path), heads).withColumnRenamed("file", "source")
    valid = {r[0].split("-")[0]: (r.rows, r.is_valid, r.message) for r in B.validate_billing_files(headers, rows).select(name, "rows", "is_valid", "message").collect()}
    assert valid["part"] == (2, True, "Parquet is valid for analysis") and valid["a.csv"][:2] == (1, True)
    assert valid["broken.parquet"] == (0, False, "Parquet file is empty") and valid["B.CSV"] == (0, False, "CSV file is empty")


def test_many_files_share_a_task(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"{i}.csv").write_text(f"a,b{i}\n1,2\n")
    heads = L.file_heads(spark, str(tmp_path))
    assert heads.count() == 150 and heads.select(F.spark_partition_id()).distinct().count() <= 3
    assert {r["columns"][1] for r in heads.collect()} == {f"b{i}" for i in range(150)}


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("cost,x\n1,2\n")
    spark.createDataFrame([(1,)], "usage int").coalesce(1).write.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(L, "_tasks_can_open", lambda path: False)
    assert {tuple(r["columns"]) for r in L.file_heads(spark, str(tmp_path)).collect()} == {("cost", "x"), ("usage",)}


def test_an_empty_zone(spark, tmp_path):
    assert L.file_heads(spark, str(tmp_path)).count() == 0 and L.file_row_counts(spark, str(tmp_path)).count() == 0
