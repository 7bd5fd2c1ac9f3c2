"""Places of rows in sorted frames, whose partitions are cut anew in each plan."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom import file_queries, queries  # noqa: F401
from sparkloom.functions.predicates import Operator
from sparkloom.operators import navigation
from sparkloom.operators.table import Table
from sparkloom.sources import pieces, readers

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture
def many_parts(spark):
    """Sorts deal out to many partitions, which are put together by few bytes."""
    names = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000"}
    names |= {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLE[name]).df()
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(rows) == sorted(want.itertuples(index=False, name=None))
    return rows


def wide(spark, n=1500):
    return spark.range(n, numPartitions=7).select(((F.col("id") * 1237) % n).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))


def test_places_of_a_sorted_frame(spark, many_parts):
    numbered = readers.with_row_index(wide(spark).orderBy("id"))
    assert numbered.rdd.getNumPartitions() > 5
    assert [(r.id, r.row) for r in numbered.collect()] == [(k, k) for k in range(1500)]
    got = navigation.ranges(wide(spark).orderBy("id"), 500).collect()
    assert sorted(tuple(r) for r in got) == [(k, k * 500, 500) for k in range(3)]


def test_only_shuffled_frames_are_kept(spark):
    scan = spark.read.text(os.path.abspath(__file__))
    assert readers.is_settled(scan.where("value <> ''"))
    assert readers.is_settled(readers.with_row_index(scan))  # sizes are shuffled and broadcast, rows are not
    assert not readers.is_settled(scan.orderBy("value").select(F.length("value")))
    assert not readers.is_settled(scan.where("value = ''").unionByName(scan.distinct()))
    assert not readers.is_settled(scan.repartition(3))
    kept = readers.settled(scan.orderBy("value"))
    assert readers.is_settled(kept) and readers.settled(kept) is kept


@tables
def test_drill_json_array(spark, many_parts):
    against_sql(spark, "drill_json_array")


@tables
def test_json_array_page(spark, many_parts):
    got = against_sql(spark, "json_array_page")
    assert [r[0] for r in got] == [str(k) for k in range(30, 50)]


def test_pages_are_taken_by_place(spark, tmp_path, capsys):
    """In any order that partitions arrive in: the rows are sorted by their places, not taken as they come."""
    (tmp_path / "x.jsonl").write_text("".join(f'{{"k":{k},"v":"{"y" * 50}"}}\n' for k in range(5000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        table = Table.open(spark, str(tmp_path / "x.jsonl"))
        assert table.records.frame.rdd.getNumPartitions() > 5
        for t, first, want in ((table, 990, range(990, 1010)), (table.filter("k", Operator.GreaterThan, "999"), 2990, range(3990, 4010))):
            page = t.page(first, 20)
            assert [int(r.k) for r in page.collect()] == list(want)
            page.explain()
            plan = capsys.readouterr().out
            assert "TakeOrderedAndProject" in plan and "CollectLimit" not in plan
        assert [r.k for r in table.page(4990, 20).collect()] == [str(k) for k in range(4990, 5000)] and not table.page(5000, 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@tables
def test_json_array_scan(spark, many_parts):
    against_sql(spark, "json_array_scan")


@pytest.fixture
def file_parts(spark):
    """Sets into how many parts files are cut at least, as more or fewer cores of executors do."""
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set(names[0], "100")
    yield lambda n: spark.conf.set(names[1], str(n))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_json_array_while_cores_change(spark, file_parts, tmp_path):
    """A lost executor changes into how many parts a plan cuts the file."""
    want = [f'{{"k":{k},"v":"{"y" * 50}"}}' for k in range(2000)]
    (tmp_path / "x.json").write_text(f"[{','.join(want)}]")
    file_parts(6)
    table = Table.open(spark, str(tmp_path / "x.json"))
    assert table.records.frame.count() == 2000
    for n in (4, 9):
        file_parts(n)
        assert [r.value for r in table.records.frame.where("value <> ''").collect()] == want
        assert sorted(int(r.k) for r in table.batch().collect()) == list(range(2000))


def test_places_while_cores_change(spark, file_parts, tmp_path):
    """Sizes of parts and rows are found in the same parts."""
    (tmp_path / "x.txt").write_text("".join(f"{k}\n" for k in range(3000)))
    file_parts(6)
    numbered = readers.with_row_index(spark.read.text(str(tmp_path / "x.txt")))
    assert numbered.rdd.getNumPartitions() == 6
    for n in (4, 9):
        file_parts(n)
        later = numbered.where("value <> ''")
        assert later.rdd.getNumPartitions() == 6
        assert sorted((int(r.value), r.row) for r in later.collect()) == [(k, k) for k in range(3000)]


@tables
def test_json_object_scan(spark, many_parts):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200")  # 150 customers
    against_sql(spark, "json_object_scan")


@pytest.mark.parametrize("text", ['{"a": 1}, "b": {"c": 2}', '{"a": 1} {"b": 2}', '{"a" 1}', '{"a": 1,}', '{"a"}', "{1: 2}"])
def test_what_is_no_object(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        pieces.object_entries(spark, str(tmp_path / "x.json")).collect()
