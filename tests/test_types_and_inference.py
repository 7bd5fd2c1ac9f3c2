import itertools

import pytest

from sparkloom.functions import inference as I
from sparkloom.sources.readers import SourceError, json_head_types
from sparkloom.types import Column, DataFormat, LogicalType, PlanError, TableSchema, join_types

T = LogicalType
TEXTS = [
    ("true", T.Boolean), ("FALSE", T.Boolean), ("yes", T.Text), ("1", T.WholeNumber), ("-42", T.WholeNumber), ("9223372036854775807", T.WholeNumber), ("9223372036854775808", T.FloatingPoint),
    ("1.5", T.FloatingPoint), ("1,002.34", T.FloatingPoint), ("1.5e10", T.FloatingPoint), ("NaN", T.FloatingPoint), ("Infinity", T.FloatingPoint), ("(5)", T.Text), ("12L", T.Text),
    ("2024-01-15", T.Timestamp), ("2024-12-31T23:59:59Z", T.Timestamp), ("12/31/2024", T.Timestamp), ("1/15/2024", T.Timestamp), ("2024-02-30", T.Text), ("", T.Text), ("abc", T.Text), (" 7 ", T.WholeNumber),
]


@pytest.mark.parametrize("text,type", TEXTS)
def test_text(text, type):
    assert I.infer_text(text) is type


def test_expression_agrees_with_python(spark):
    df = spark.createDataFrame([(t,) for t, _ in TEXTS], "v string")
    got = [r.t for r in df.select(I.inferred_type(df.v).alias("t")).collect()]
    assert got == [None if not t.strip() else k.name for t, k in TEXTS]


@pytest.mark.parametrize("kind,raw,type", [("number", "1", T.WholeNumber), ("number", "1.50", T.FloatingPoint), ("number", "1e10", T.Text), ("number", "9223372036854775808", T.Text), ("bool", "true", T.Boolean), ("string", "5", T.Text), ("string", "2024-01-15", T.Timestamp), ("object", "{}", T.JsonObject), ("array", "[]", T.JsonArray), ("null", "null", None)])
def test_token(kind, raw, type):
    assert I.infer_token(kind, raw) is type


def test_join_is_a_semilattice():
    for a, b, c in itertools.product(T, repeat=3):
        assert join_types(a, b) is join_types(b, a)
        assert join_types(join_types(a, b), c) is join_types(a, join_types(b, c))
    assert join_types(T.WholeNumber, T.FloatingPoint) is T.FloatingPoint
    assert join_types(T.WholeNumber, T.Boolean) is T.Text
    assert join_types(T.JsonObject, T.JsonArray) is T.Text
    assert join_types(T.Timestamp, T.Text) is T.Text


def test_schema_refuses_repeated_and_blank_names():
    with pytest.raises(PlanError, match="Duplicate"):
        TableSchema.of([("a", T.Text, False), ("a", T.Text, False)], DataFormat.Csv)
    assert len(TableSchema.of([("a", T.Text, False), ("A", T.Text, False)], DataFormat.Csv).columns) == 2
    with pytest.raises(PlanError):
        Column(" ", T.Text)
    with pytest.raises(PlanError):
        TableSchema((), DataFormat.Csv)


def test_json_head():
    got = json_head_types(['{"a":1,"n":null}', "broken", '{"a":1.5,"b":true,"n":3}', '{"b":false}'])
    assert got == {"a": (T.FloatingPoint, True), "n": (T.Text, True), "b": (T.Boolean, True)}
    assert json_head_types(['{"a":1}', '{"a":"x"}'])["a"] == (T.Text, False)
    with pytest.raises(SourceError):
        json_head_types(["", "[1]"])
