import pytest

from sparkloom import cli

EMPTY = 'name: "x"\nactions: []\n'


def act(*items):
    return 'name: "x"\nactions:\n' + "".join(f"  - type: {kind}\n" + "".join(f'    {k}: "{v}"\n' if k not in ("operator", "targetType") else f"    {k}: {v}\n" for k, v in fields.items()) for kind, fields in items)


@pytest.fixture
def run(spark, tmp_path):
    def go(name, text, recipe, out, code=0):
        (tmp_path / name).write_text(text, "utf-8")
        (tmp_path / "r.yaml").write_text(recipe, "utf-8")
        got = cli.main(["--cli", "--input", str(tmp_path / name), "--recipe", str(tmp_path / "r.yaml"), "--output", str(tmp_path / out)], spark)
        assert got == code
        return (tmp_path / out).read_text("utf-8") if not code else None

    return go


PEOPLE = "name,age\nAlice,30\nBob,25\nCharlie,35\n"


def test_csv_to_csv(run):
    assert run("p.csv", PEOPLE, EMPTY, "o.csv") == PEOPLE
    assert run("h.csv", "name,age\n", EMPTY, "o2.csv") == "name,age\n"
    assert run("q.csv", 'a,b\n"x,1",\n"say ""hi""",z\n', EMPTY, "o3.csv") == 'a,b\n"x,1",""\n"say ""hi""",z\n'
    assert run("m.csv", 'a,b\n"x\ny",1\n', EMPTY, "o4.csv") == 'a,b\n"x\ny",1\n'


def test_actions(run):
    recipe = act(("rename", {"oldName": "name", "newName": "n"}), ("filter", {"columnName": "age", "operator": "greaterThan", "value": "26"}))
    assert run("p.csv", PEOPLE, recipe, "o.csv") == "n,age\nAlice,30\nCharlie,35\n"
    assert run("p.csv", PEOPLE, act(("delete", {"columnName": "name"}), ("delete", {"columnName": "age"})), "o.jsonl") == "{}\n{}\n{}\n"
    assert run("p.csv", PEOPLE, act(("cast", {"columnName": "name", "targetType": "WholeNumber"}), ("filter", {"columnName": "name", "operator": "LessThan", "value": "5"})), "o2.csv") == "name,age\n"
    assert run("p.csv", PEOPLE, act(("fill", {"columnName": "age", "value": "0"}), ("filter", {"columnName": "age", "operator": "Equals", "value": "30"})), "o3.jsonl") == '{"name":"Alice","age":0}\n'


def test_csv_to_json_lines_types_the_text(run):
    assert run("c.csv", "id,code,ok\n1,007,TRUE\n2,,no\n", EMPTY, "o.jsonl") == '{"id":1,"code":7,"ok":true}\n{"id":2,"code":"","ok":"no"}\n'
    assert run("d.csv", "date\n2024-03-15\n", act(("format_timestamp", {"columnName": "date", "targetFormat": "yyyyMMdd"})), "o2.jsonl") == '{"date":20240315}\n'


def test_json_lines_keep_their_spelling(run):
    text = '{"id":1,"data":{"city":"café","nested":{"count": 2}},"tags":["a","b"]}\n{"id":1.50,"data":1e10}\n\n{"data":null,"id":"5"}\n{"id":"<null>","tags":9223372036854775808}\n'
    assert run("n.jsonl", text, EMPTY, "o.jsonl") == '{"id":1,"data":{"city":"café","nested":{"count": 2}},"tags":["a","b"]}\n{"id":1.50,"data":1e10}\n{"id":"5","data":null}\n{"id":"<null>","tags":9223372036854775808}\n'
    assert run("t.jsonl", '{"a":1,"b":2}\n{"a": 3, "b": {"x": \n', EMPTY, "o2.jsonl") == '{"a":1,"b":2}\n{"a":3,"b":""}\n'
    assert run("n2.jsonl", '{"id":1,"data":{"c":"é"},"b":true}\n{"id":null}\n', EMPTY, "o.csv") == 'id,data,b\n1,"{""c"":""é""}",true\n,,\n'


def test_json_filters_drop_rows_without_the_value(run):
    text = '{"a":1,"b":"X"}\n{"a":2,"b":null}\n{"a":3}\n{"a":4,"b":"y"}\n{"a":5,"b":true}\n'
    keep = lambda op, v: run("f.jsonl", text, act(("filter", {"columnName": "b", "operator": op, "value": v}), ("delete", {"columnName": "b"})), f"{op}.jsonl")
    assert keep("NotEquals", "x") == '{"a":4}\n{"a":5}\n'
    assert keep("Equals", "true") == '{"a":5}\n'


def test_failures(run, spark, tmp_path, capsys):
    run("r.csv", "a,b\n1,2\n3\n", EMPTY, "o.csv", 1)
    run("d.csv", "a,a\n1,2\n", EMPTY, "o.csv", 1)
    run("x.csv", "a\nb\n", act(("format_timestamp", {"columnName": "a", "targetFormat": "yyyy"})), "o.csv", 1)
    run("y.json", "[1]", EMPTY, "o.csv", 1)
    run("z.csv", "a\n2024-01-01\nbad\n", act(("format_timestamp", {"columnName": "a", "targetFormat": "yyyy"})), "o.csv", 1)
    run("e.csv", "", EMPTY, "o.csv", 1)
    assert cli.main([], spark) == 1
    assert "nothing to do" in capsys.readouterr().err


@pytest.mark.parametrize("args,error", [(["x"], "expected a flag in place of 'x'"), (["--nope"], "there is no flag --nope"), (["--input"], "--input needs a value"), (["--input", "--recipe"], "--input needs a value"), (["--cli", "--input", "a", "--recipe", "b"], "--output is needed")])
def test_arguments(args, error):
    with pytest.raises(cli.UsageError, match=error):
        cli.parse_arguments(args)
