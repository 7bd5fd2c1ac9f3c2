import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions import jsontext as J
from sparkloom.operators import navigation as N


def test_first_of_repeated_keys_and_lexemes():
    line = '{"a": 1.50, "a": 2, "b": 1e10, "c": {"x":  1e10}, "d": "q\\n", "e": null, "f": false}'
    got = dict(zip("abcdefg", J.find(line, list("abcdefg")), strict=True))
    assert got["a"] == ("number", "1.50", "1.5")
    assert got["b"] == ("number", "1e10", "10000000000")
    assert got["c"] == ("object", '{"x":  1e10}', "{Object: 1 properties}")
    assert got["d"] == ("string", "q\n", "q\\n")
    assert got["e"] == ("null", None, "<null>")
    assert got["f"] == ("bool", "false", "False")
    assert got["g"] == ("missing", None, "<null>")


def test_what_stands_before_an_error():
    assert [k for k, _, _ in J.find('{"a": 1, "b": {"c": ', ["a", "b", "z"])] == ["number", "invalid", "invalid"]
    assert J.find("", ["a"]) == [("invalid", None, "<error>")]
    assert J.find("[1]", ["a"])[0][0] == "invalid"
    assert J.find('{"a": 1} trailing', ["b"])[0][0] == "missing"


@pytest.mark.parametrize("text", ['{"a":01}', '{"a":NaN}', '{"a" 1}', '{"a":1,}', '{"a":"\n"}', '{a:1}', '{"a":[1,]}'])
def test_malformed(text):
    assert J.find(text, ["a", "zz"])[1][0] == "invalid"


def test_counts():
    assert J.display(J.Value("object", '{"a":1,"a":{"b":1}}')) == "{Object: 2 properties}"
    assert J.display(J.Value("array", "[1,[2,3],{}]")) == "[Array: 3 items]"
    assert J.display(J.Value("array", json.dumps([0] * 1200))) == "[Array: 1,200 items]"


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), values, max_size=5), st.booleans())
def test_members_are_what_json_reads(value, ascii):
    text = json.dumps(value, ensure_ascii=ascii)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    got = {k: json.loads(J.source(v)) for k, v in J.members(text)}
    assert got == value or any("\ud800" <= c <= "\udfff" for k in value for c in k)


def test_tree():
    assert N.children('{"s":"a\\n\\"","n":1.50,"o":{"x":1},"z":null,"t":true}') == [("s", "string", 's: "a\\n\\""'), ("n", "number", "n: 1.50"), ("o", "object", "o: {Object: 1 properties}"), ("z", "null", "z: <null>"), ("t", "bool", "t: true")]
    assert N.children("[1,[2]]") == [("[0]", "number", "[0]: 1"), ("[1]", "array", "[1]: [Array: 1 items]")]
    assert N.search_label("[12]") == 12


def test_viewport_and_ranges():
    v = N.Viewport(0, 10, 25)
    assert (v.page_down().top, v.page_down().page_down().top, v.last().top, v.last().bottom, v.page_up().top) == (10, 15, 15, 24, 0)
    assert N.Viewport(0, 10, 3).last().bottom == 2
    assert N.range_size(10) == 1000
    assert N.range_size(100_000_000) == 1000
    assert N.range_size(100_000_100) == 2000
