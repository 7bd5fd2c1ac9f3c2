import pytest

from sparkloom.functions.predicates import Operator as Op
from sparkloom.plans import actions as A
from sparkloom.plans import recipe as R
from sparkloom.plans.plan import Mode, fold
from sparkloom.types import DataFormat, LogicalType, PlanError, TableSchema

T = LogicalType
SCHEMA = TableSchema.of([("a", T.WholeNumber, False), ("b", T.Text, False), ("c", T.Timestamp, False)], DataFormat.Csv)
RECIPE = R.Recipe("people \"x\" \\", (A.Rename("nm", "name"), A.Delete("z"), A.Cast("q", T.Boolean), A.Filter("age", Op.GreaterThan, "25"), A.Fill("email", ""), A.FormatTimestamp("t", "yyyy")), "about", "2026-07-26T12:34:56.0000000+00:00")


def names(plan):
    return [o.name for o in plan.visible]


def test_round_trips():
    assert R.parse(R.serialize(RECIPE)) == RECIPE
    assert R.from_json(R.to_json(RECIPE)) == RECIPE
    assert R.serialize(R.Recipe("e")) == 'name: "e"\nactions: []\n'
    assert R.parse('# c\r\nname: e\r\n\r\nactions:\r\n  - type: delete\r\n    columnName: "a\\"b"\r\n').actions == (A.Delete('a"b'),)


@pytest.mark.parametrize(
    "text,error",
    [
        ("actions: []", "a recipe needs a name"),
        ("name: a\nname: b", "the key 'name' stands twice"),
        ("name: a\nfoo: b", "a recipe has no key 'foo'"),
        ("name: a\nfoo", "no key and value"),
        ("name: a\nlastModified: soon", "lastModified is no time"),
        ("name: a\nactions:\n  - type: sort", "there is no action 'sort'"),
        ("name: a\nactions:\n- type: delete", "belongs to no action"),
        ("name: a\nactions:\n    columnName: x", "belongs to no action"),
        ("name: a\nactions:\n  - type: delete\n    columnName", "Malformed action field"),
        ("name: a\nactions:\n  - type: rename\n    oldName: x", "a rename action needs newName"),
        ("name: a\nactions:\n  - type: cast\n    columnName: x\n    targetType: boolean", "'boolean' is no targetType"),
        ("name: a\nactions:\n  - type: filter\n    columnName: x\n    operator: like\n    value: y", "'like' is no operator"),
        ('name: a\nactions:\n  - type: format_timestamp\n    columnName: x\n    targetFormat: " "', "is blank"),
    ],
)
def test_refused_recipes(text, error):
    with pytest.raises(R.RecipeError, match=error.replace("(", "\\(")):
        R.parse(text)


def test_enums_by_case():
    text = "name: a\nactions:\n  - type: filter\n    columnName: x\n    operator: greaterthan\n    value: y"
    assert R.parse(text).actions == (A.Filter("x", Op.GreaterThan, "y"),)


def test_names_are_current_ones():
    assert names(fold(SCHEMA, (A.Rename("a", "x"), A.Rename("x", "y"), A.Delete("a")))) == ["y", "b", "c"]
    assert names(fold(SCHEMA, (A.Rename("a", "b"),))) == ["b", "c"]
    assert names(fold(SCHEMA, (A.Rename("a", "b"), A.Delete("b")))) == ["c"]
    assert names(fold(SCHEMA, tuple(map(A.Delete, "abc")))) == []
    assert names(fold(SCHEMA, (A.Delete("nope"), A.Fill("nope", "1"), A.Rename("nope", "x")))) == ["a", "b", "c"]


def test_filters_see_the_source_and_the_type_in_force():
    plan = fold(SCHEMA, (A.Filter("a", Op.Equals, "1"), A.Cast("a", T.Text), A.Filter("a", Op.Equals, "2"), A.Delete("a"), A.Filter("a", Op.Equals, "3")))
    assert [(f.source, f.type, f.value) for f in plan.filters] == [("a", T.WholeNumber, "1"), ("a", T.Text, "2")]


def test_batch_and_view_differ():
    stack = (A.Fill("c", "5"), A.FormatTimestamp("c", "yyyy"))
    batch = fold(SCHEMA, stack).visible[2]
    view = fold(SCHEMA, stack, Mode.View).visible[2]
    assert (batch.fill, batch.format, batch.type) == (None, "yyyy", T.Timestamp)
    assert (view.fill, view.format, view.type) == ("5", "yyyy", T.WholeNumber)
    with pytest.raises(PlanError):
        fold(SCHEMA, (A.FormatTimestamp("b", "yyyy"),))
    assert fold(SCHEMA, (A.FormatTimestamp("b", "yyyy"),), Mode.View).visible[1].format == "yyyy"
