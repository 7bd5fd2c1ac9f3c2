import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.functions import timestamps as T
from sparkloom.types import LogicalType

DOUBLES = {"1": 1.0, "1,234.5": 1234.5, "(5)": -5.0, "5-": -5.0, "¤5": 5.0, " 7 ": 7.0, "1e3": 1000.0, "1d": None, "": None, ".": None, "(-5)": None, "-Infinity": -math.inf, "1.9": 1.9}


def test_parse_double(spark):
    df = spark.createDataFrame([(k,) for k in DOUBLES], "v string")
    assert {r.v: r.d for r in df.select("v", S.parse_double(df.v).alias("d")).collect()} == DOUBLES


def test_parse_long(spark):
    cases = {"30": 30, " -7 ": -7, "+1": 1, "1.9": None, "12L": None, "9223372036854775808": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.d for r in df.select("v", S.parse_long(df.v).alias("d")).collect()} == cases


NUMBERS = {-0.0: "-0", 100.0: "100", 1e14: "100000000000000", 1e15: "1E+15", 1.5e16: "1.5E+16", 0.0001: "0.0001", 0.00001: "1E-05", 12345678.9: "12345678.9", -2.5: "-2.5", math.inf: "Infinity", 1.7976931348623157e308: "1.7976931348623157E+308"}


@pytest.mark.parametrize("d,text", NUMBERS.items())
def test_double_text(d, text):
    assert S.double_text_py(d) == text


def test_double_text_expression(spark):
    more = [*NUMBERS, 0.1 + 0.2, 123456.789e-3, 9.999e-5, 1e-300, 1e-4, 99999999999999.9]
    df = spark.createDataFrame([(float(d),) for d in more], "v double")
    for r in df.select("v", S.double_text(df.v).alias("t")).collect():
        assert r.t == S.double_text_py(r.v)


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_double_text_reads_back(d):
    assert float(S.double_text_py(d)) == d


@pytest.mark.parametrize("type,cases", [(LogicalType.WholeNumber, {"007": "7", "x": "<invalid>", "1.5": "<invalid>"}), (LogicalType.FloatingPoint, {"1,000.50": "1000.5", "": "<invalid>"}), (LogicalType.Boolean, {" TRUE ": "true", "yes": "<invalid>", "1": "<invalid>"}), (LogicalType.Timestamp, {"1/15/2024": "2024-01-15 00:00:00", "no": "<invalid>"}), (LogicalType.Text, {"<x>": "<x>"})])
def test_render(spark, type, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", S.render(df.v, type).alias("t")).collect()} == cases


def test_json_scalar(spark):
    cases = {"007": "7", "true": "true", "TRUE": "true", "1.50": "1.5", "a\"b\\\n\x01é": '"a\\"b\\\\\\n\\u0001é"', "": '""', "NaN": '"NaN"', "1,000": "1000", "17.0": "17", "0.010": "0.01", "100.50": "100.5", "0.00": "0", "-0": "0", "0.00001": "1E-05", "0.0001": "0.0001", "1e3": "1000", "2024-01-01": '"2024-01-01"'}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", S.json_scalar(df.v).alias("t")).collect()} == cases


def test_timestamps(spark):
    cases = {"2024-01-15 10:30": "2024-01-15 10:30:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5 March 2024": "2024-03-05 00:00:00", "1/2/2024 3:04 PM": "2024-01-02 15:04:00", "2024-01-01T00:00:00+09:00": "2023-12-31 15:00:00", "2024-01-01T00:00:00.1234567Z": "2024-01-01 00:00:00.123456", "2024": None, "12:30": None, "13/13/2024": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.select("v", T.parse_timestamp(df.v).cast("string").alias("t")).collect():
        assert r.t == cases[r.v], r.v
        assert T.is_timestamp(r.v) == (r.t is not None), r.v


@pytest.mark.parametrize("net,spark_format", [("yyyy-MM-dd", "yyyy-MM-dd"), ("dddd, MMM d yyyy", "EEEE, MMM d yyyy"), ("yyyy-MM-ddTHH:mm:ss.fff", "yyyy-MM-dd'T'HH:mm:ss.SSS"), ("hh:mm tt zzz", "hh:mm a xxx"), ("'at' H\\h", "'at 'H'h'"), ("s", "yyyy-MM-dd'T'HH:mm:ss")])
def test_formats(net, spark_format):
    assert T.spark_pattern(net) == spark_format


@pytest.mark.parametrize("net", ["yyy", "K", "t tt", "FFF", "'open", "q"])
def test_refused_formats(net):
    with pytest.raises(T.FormatError):
        T.spark_pattern(net)


def test_escaped(spark):
    df = spark.createDataFrame([('a\n"b"\t',)], "v string")
    assert df.select(S.escaped(F.col("v"))).first()[0] == 'a\\n\\"b\\"\\t'
