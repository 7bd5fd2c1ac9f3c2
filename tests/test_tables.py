import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.predicates import Operator as Op
from sparkloom.operators import drilldown as D
from sparkloom.operators.table import Table
from sparkloom.plans.recipe import Recipe
from sparkloom.sources import readers
from sparkloom.streaming import replay
from sparkloom.types import DataFormat, LogicalType, PlanError

T = LogicalType


@pytest.fixture
def file(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, "utf-8")
        return str(tmp_path / name)

    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_detection(spark, file):
    kinds = {"a.csv": "a\n", "a.jsonl": "{}\n", "a.json": "﻿ \n[1]", "b.json": " {}"}
    assert [readers.detect(spark, file(n, t)) for n, t in kinds.items()] == [DataFormat.Csv, DataFormat.JsonLines, DataFormat.JsonArray, DataFormat.JsonObject]
    for name, text, error in (("c.json", "1", "Neither"), ("d.txt", "x", "Unsupported"), ("e.csv", "", "empty")):
        with pytest.raises(readers.SourceError, match=error):
            readers.detect(spark, file(name, text))
    with pytest.raises(readers.SourceError, match="not found"):
        readers.detect(spark, "/nowhere.csv")


def test_csv_schema(spark, file):
    t = Table.open(spark, file("s.csv", "id,name,opt,salary,active,created,\n1,A,,50000.50,true,2024-01-15,x\n2,B,5,1,FALSE,1/2/2024,\n"))
    assert [(c.name, c.type, c.nullable) for c in t.schema.columns] == [("id", T.WholeNumber, False), ("name", T.Text, False), ("opt", T.Text, True), ("salary", T.FloatingPoint, False), ("active", T.Boolean, False), ("created", T.Timestamp, False), ("Column7", T.Text, True)]
    assert rows(t.view())[1][-1] == ""


def test_head_of_200_and_refinement(spark, file):
    text = "v\n" + "1\n" * 200 + "x\n"
    t = Table.open(spark, file("h.csv", text))
    assert t.schema.columns[0].type is T.WholeNumber
    assert t.refined().schema.columns[0].type is T.Text
    j = Table.open(spark, file("h.jsonl", '{"a":1}\n' * 200 + '{"a":1.5,"late":true}\n'))
    assert [c.name for c in j.schema.columns] == ["a"]
    assert [(c.name, c.type, c.nullable) for c in j.refined().schema.columns] == [("a", T.FloatingPoint, False), ("late", T.Boolean, True)]


def test_literal_quotes(spark, file):
    path = file("q.csv", 'a,b\n"x,1",2\n')
    assert rows(Table(readers.read_csv(spark, path, quote_mode="literal")).view()) == [('"x,1"', "2")]


def test_view_mode(spark, file):
    t = Table.open(spark, file("v.csv", "n,v\na,1\nb,\nc,3\n"))
    assert t.headers() == ["n (text)", "v (number)"]
    assert rows(t.view()) == [("a", "1"), ("b", ""), ("c", "3")]
    assert rows(t.rename("n", "m").view())[1] == ("b", "<invalid>")
    assert rows(t.filter("v", Op.GreaterThan, "0").filtered_index()) == [(0, 0), (1, 2)]
    assert rows(t.page(1, 1)) == [("b", "")]
    assert rows(t.fill("v", "x").clear().view()) == rows(t.view())
    with pytest.raises(PlanError):
        t.rename("n", " ")
    with pytest.raises(PlanError):
        t.filter("n", Op.Equals, " ")
    with pytest.raises(PlanError):
        t.cast("n", T.JsonObject)


def test_json_view_compares_displayed_text(spark, file):
    t = Table.open(spark, file("j.jsonl", '{"a":1,"b":"x"}\n{"a":2}\n'))
    assert rows(t.filter("b", Op.NotEquals, "x").view()) == [("2", "<null>")]


def test_ragged_rows_are_padded_in_view(spark, file):
    assert rows(Table.open(spark, file("r.csv", "a,b\n1,2\n3\n4,5,6\n")).view()) == [("1", "2"), ("3", ""), ("4", "5")]


def test_typed_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    t = Table.of(spark.read.parquet(str(tmp_path / "t"))).filter("id", Op.GreaterThan, "90").delete("s")
    plan = t.batch()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_case_of_text(spark):
    df = spark.createDataFrame([("straße",), ("STRASSE",), ("İ",), ("i",), ("AbC",)], "v string")
    find = lambda op, v: [r.v for r in Table.of(df).filter("v", op, v).batch().collect()]
    assert find(Op.Equals, "strasse") == ["STRASSE"]
    assert find(Op.Contains, "BC") == ["AbC"]
    assert find(Op.Equals, "I") == ["i"]


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "concat('n', id) name").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
    recipe = Recipe("s", Table.of(spark.createDataFrame([], "id long, name string")).filter("id", Op.LessThan, "3").fill("name", "x").actions)
    q = replay(stream, recipe).writeStream.format("memory").queryName("replayed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("replayed"))) == [(0, "x"), (1, "x"), (2, "x")]


# --- drill-down

RECORDS = {
    "object leaf": (['{"user":{"name":"Alice","age":30}}', '{"user":{"name":"Bob","age":25}}'], ("user",), ["name", "age"], [("0", "Alice", "30"), ("1", "Bob", "25")]),
    "array of objects": (['{"orders":[{"id":"A1","q":2},{"id":"A2","q":5}]}', '{"orders":[{"id":"B1","q":1}]}'], ("orders",), ["id", "q"], [("0:0", "A1", "2"), ("0:1", "A2", "5"), ("1:0", "B1", "1")]),
    "primitives": (['{"tags":["dev","ops"]}', '{"tags":["dev"]}'], ("tags",), ["value"], [("0:0", "dev"), ("0:1", "ops"), ("1:0", "dev")]),
    "scalar": (['{"score":88}', '{"score":null}'], ("score",), ["score"], [("0", "88"), ("1", "<null>")]),
    "index is parent": (['{"orders":[{"id":"A1"},{"id":"A2"}]}'], ("orders", 0), ["id"], [("0:0", "A1"), ("0:1", "A2")]),
    "two levels": (['{"orders":[{"tags":["urgent","gift"]},{"tags":["normal"]}]}'], ("orders", 0, "tags"), ["value"], [("0:0:0", "urgent"), ("0:0:1", "gift"), ("0:1:0", "normal")]),
    "nested cell": (['{"user":{"a":{"x":1},"t":[1,2]}}'], ("user",), ["a", "t"], [("0", "{Object: 1 properties}", "[Array: 2 items]")]),
    "empty array": (['{"tags":[]}', '{"tags":["x"]}'], ("tags",), ["value"], [("1:0", "x")]),
    "mixed array": (['{"items":[{"id":"A1"},"loose"]}'], ("items",), ["id", "value"], [("0:0", "A1", "<null>"), ("0:1", "<null>", "loose")]),
    "empty path": (['{"name":"A","age":1}'], (), ["name", "age"], [("0", "A", "1")]),
    "bracket key": (['{"[0]":{"a":1}}'], ("[0]",), ["a"], [("0", "1")]),
    "missing in some": (['{"a":{"b":1}}', '{"z":1}', "5"], ("a",), ["b"], [("0", "1")]),
}


def path(steps):
    return tuple(D.Key(s) if isinstance(s, str) else D.Index(f"[{s}]") for s in steps)


@pytest.mark.parametrize("case", RECORDS)
@pytest.mark.parametrize("kind", ["lines", "array"])
def test_drill(spark, file, case, kind):
    records, steps, columns, want = RECORDS[case]
    if kind == "lines":
        t = D.drill(spark, file("d.jsonl", "\n".join(records) + "\n"), path(steps))
        want = [(":".join([str(int(r[0].split(":")[0]) + 1), *r[0].split(":")[1:]]), *r[1:]) for r in want]
    else:
        t = D.drill(spark, file("d.json", f"[{', '.join(records)}]"), path(steps))
    assert [c.name for c in t.schema.columns] == columns
    assert rows(t.focused()) == want


def test_drill_details(spark, file):
    t = D.drill(spark, file("b.jsonl", '{"score":1}\n\n{"score":3}\n'), path(["score"]))
    assert [r[0] for r in rows(t.focused())] == ["1", "3"]
    assert t.schema.columns[0].type is T.Text
    t = D.drill(spark, file("n.jsonl", '{"u":{"a":1,"b":null}}\n{"u":{"a":2.5,"b":true}}\n'), path(["u"]))
    assert [(c.name, c.type, c.nullable) for c in t.schema.columns] == [("a", T.FloatingPoint, False), ("b", T.Boolean, True)]
    assert rows(t.filter("a", Op.GreaterThan, "2").batch()) == [("2.5", "true")]
    for name, text, error in (("x.jsonl", '{"a":1}\n', "no rows"), ("y.jsonl", '{"z":{}}\n', "no columns"), ("o.json", '{"z":1}', "Full aggregation")):
        with pytest.raises(D.DrillDownError, match=error):
            D.drill(spark, file(name, text), path(["z"]))


def test_drill_node(spark, file):
    text = json.dumps({"user": "a", "orders": [{"id": 1, "price": 12.5}, {"id": 2, "price": 1.2}], "none": [], "mix": [1, {}], "deep": {"x": [{"q": 1}]}})
    f = file("o.json", text)
    assert rows(D.drill_node(spark, f, path(["orders"])).focused()) == [("[0]", "1", "12.5"), ("[1]", "2", "1.2")]
    assert rows(D.drill_node(spark, f, path(["deep", "x"])).focused()) == [("[0]", "1")]
    for key, error in (("none", "empty"), ("mix", "not objects"), ("user", "Only an array"), ("zzz", "nowhere")):
        with pytest.raises(D.DrillDownError, match=error):
            D.drill_node(spark, f, path([key]))


def test_json_files(spark, file):
    assert rows(readers.array_elements(spark, file("a.json", '[1, "x", {"a": [2]}, null]'))) == [(0, "1"), (1, '"x"'), (2, '{"a": [2]}'), (3, "null")]
    assert rows(readers.object_entries(spark, file("o.json", '{"b":1,"a":2,"b":3}'))) == [(0, "b", "3"), (1, "a", "2")]
    assert D.path_of([("object", "a"), ("array", "[0]"), ("object", "[1]")]) == (D.Key("a"), D.Index("[0]"), D.Key("[1]"))
    assert D.path_text((D.Key("a"), D.Index("[0]"), D.Key("b"))) == "a[*] > b" and D.path_text(()) == "root"


def test_row_store_reads_a_range_by_itself(spark, tmp_path):
    from sparkloom.operators.navigation import RowStore

    frame = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("value")).coalesce(3)
    store = RowStore.build(frame, str(tmp_path / "rows"))
    assert [tuple(r) for r in RowStore.open(spark, str(tmp_path / "rows")).rows(2999, 3).select("row", "value").collect()] == [(k, f"v{k}") for k in (2999, 3000, 3001)]
    assert [r.row for r in store.range(4, 1000).select("row").collect()] == list(range(4000, 5000))
    plan = store.rows(10, 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(row,10)" in plan and "LessThan(row,15)" in plan  # pushed to the scan


def test_row_cache(spark, tmp_path):
    from sparkloom.operators.navigation import RowCache, RowStore

    cache = RowCache(RowStore.build(spark.range(100).select(F.col("id").alias("value")), str(tmp_path / "rows")), capacity=20, window=10)
    assert [cache.get(k).value for k in (50, 49, 54, 45)] == [50, 49, 54, 45] and cache.fetched == 1
    assert cache.get(100) is None and cache.get(0).value == 0
    for k in (20, 40, 60, 80):
        assert cache.get(k).value == k and len(cache.held) <= 20
    before = cache.fetched
    assert cache.get(80).value == 80 and cache.fetched == before
    assert cache.get(0).value == 0 and cache.fetched == before + 1


def test_byte_ranges(spark, tmp_path):
    from sparkloom.sources.ranged import ByteFile

    (tmp_path / "x").write_bytes(bytes(range(256)))
    file = ByteFile.open(spark, str(tmp_path / "x"))
    assert file.read(250, 6) == bytes(range(250, 256)) and file.read(3, 0) == b"" and file.try_read(255, 2) is None
    for bad in ((-1, 2), (0, 257), (256, 1)):
        with pytest.raises(readers.SourceError):
            file.read(*bad)
    (tmp_path / "empty").write_bytes(b"")
    for name in ("empty", "none"):
        with pytest.raises(readers.SourceError):
            ByteFile.open(spark, str(tmp_path / name))
