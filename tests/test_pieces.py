"""JSON Array and Object files cut by many tasks, and trees, tables and drill-downs of them."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.predicates import Operator
from sparkloom.operators import drilldown
from sparkloom.operators.drilldown import Key
from sparkloom.operators.table import Table
from sparkloom.sources import pieces

STRINGS = ["a,b", 'q"x', "\\", "\\\\\"", "[{", '日, "]', "", "x" * 50, "}],"]


@pytest.fixture
def small_parts(spark):
    names = {"spark.sql.files.maxPartitionBytes": "313", "spark.sql.files.openCostInBytes": "50"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.3:
        return r.choice([1, 2.5, None, True, *STRINGS])
    if k < 0.6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["a", "b,", 'c"', "d\\"]): value(r, depth + 1) for _ in range(r.randint(0, 3))}


@pytest.mark.parametrize("n", [0, 1, 2, 90])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_and_objects(spark, small_parts, tmp_path, n, indent):
    r = random.Random(n)
    array = [value(r) for _ in range(n)]
    file = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text("﻿" + json.dumps(array, indent=indent, ensure_ascii=False) + "\n", "utf-8")
    assert [(x.pos, json.loads(x.value)) for x in pieces.array_elements(spark, file).collect()] == list(enumerate(array))
    members = {f'k{i}",': v for i, v in enumerate(array)}
    (tmp_path / "x.json").write_text(json.dumps(members, indent=indent), "utf-8")
    got = {x.key: json.loads(x.value) for x in pieces.object_entries(spark, file).collect()}
    assert got == members and list(got) == list(members)
    if n == 90:
        assert spark.read.option("lineSep", ",").text(file).rdd.getNumPartitions() > 3


@pytest.mark.parametrize("text", ["[1, 2", "[1 2]", "{}", "[1,]", "7", '["a]', "[tru]", "[[1]]]"])
def test_what_is_no_array(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        pieces.array_elements(spark, str(tmp_path / "x.json")).collect()


def test_repeated_keys_and_long_values(spark, small_parts, tmp_path):
    long = ["y" * 100] * 40
    (tmp_path / "x.json").write_text('{"a": 1, "b": %s, "a": {"c": 2}, "z": 1.50}' % json.dumps(long))
    got = [(x.pos, x.key, x.value) for x in pieces.object_entries(spark, str(tmp_path / "x.json")).collect()]
    assert got == [(0, "a", '{"c": 2}'), (1, "b", json.dumps(long)), (3, "z", "1.50")]


def test_scan_of_escapes():
    scan = pieces.Scan(False, 0)
    text = r'["a\"," , "b\\", [","], 3, "\\\","]'
    found, depths = scan.commas(np.frombuffer(text.encode(), np.uint8))
    assert [text[k - 1 : k + 2] for k in found[depths == 1]] == [" , ", '", ', "], ", "3, "] or len(found[depths == 1]) == 4
    assert not scan.within and scan.depth == 0


def test_tree_and_table(spark, tmp_path):
    file = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"a": 1, "n": [{"b": 1}]}\n\n{"a": 2, "n": [{"b": 2}, {"b": 3}]}\n')
    table = Table.open(spark, file).filter("a", Operator.GreaterThan, "1")
    tree = drilldown.as_tree(spark, file, table)
    assert [tuple(x) for x in tree.roots().select("pos", "label").collect()] == [(1, "1"), (3, "3")]
    assert tree.table().actions == table.actions and tree.table().batch().count() == 1
    drilled = tree.drill((Key("n"),))
    assert [tuple(x) for x in drilled.focused().collect()] == [("1:0", "1"), ("3:0", "2"), ("3:1", "3")]
    assert drilled.back(spark) is tree
    assert drilldown.drill(spark, file, (Key("n"),)).back(spark) == drilldown.Tree(spark, file)
    with pytest.raises(drilldown.DrillDownError):
        drilldown.as_tree(spark, file, Table.of(spark.range(1).select(F.col("id"))))


def test_tree_of_an_object(spark, tmp_path):
    file = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text('{"m": {"rows": [{"a": 1}, {"a": null, "b": "x"}]}, "k": 1}')
    tree = drilldown.Tree.open(spark, file)
    assert [(x.label, x.value) for x in tree.roots().collect()][1] == ("k", "1")
    drilled = tree.drill((Key("m"), Key("rows")))
    assert [(c.name, c.type.value, c.nullable) for c in drilled.schema.columns] == [("a", "number", True), ("b", "text", True)]
    assert [tuple(x) for x in drilled.focused().collect()] == [("[0]", "1", "<null>"), ("[1]", "<null>", "x")]
    for path in ((Key("none"),), (Key("k"),), (Key("m"),)):
        with pytest.raises(drilldown.DrillDownError):
            tree.drill(path)
    with pytest.raises(drilldown.DrillDownError):
        tree.table()
