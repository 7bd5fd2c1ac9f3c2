"""Queries that write the driver's tables as files, and read these; and those of schemas, paths and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.functions import jsontext, scalars
from sparkloom.functions.predicates import Operator as Op
from sparkloom.operators import drilldown, navigation
from sparkloom.operators.drilldown import Index, Key
from sparkloom.operators.table import Table
from sparkloom.plans import recipe as recipes
from sparkloom.queries import RECIPE, query, read, table
from sparkloom.sources import readers, writers
from sparkloom.sources.ranged import ByteFile
from sparkloom.sources.readers import with_row_index
from sparkloom.sources.scratch import scratch
from sparkloom.types import LogicalType


def lines_file(spark: SparkSession, lines: DataFrame, name: str, header: str | None = None) -> str:
    """Writes column value, in the frame's order, to one file of that name."""
    file = f"{scratch(spark, 'files')}/{name}"
    writers.write_one(spark, lines, file, header)
    return file


def csv_file(spark: SparkSession, frame: DataFrame) -> str:
    """The frame as a CSV file, by the sink of batch runs."""
    header, lines = Table.of(frame).csv_lines()
    return lines_file(spark, lines, "x.csv", header)


def json_file(spark: SparkSession, frame: DataFrame, name: str = "x.jsonl") -> str:
    """The frame as a JSON Lines file, by the sink of batch runs."""
    return lines_file(spark, Table.of(frame).json_lines(), name)


def json_value_file(spark: SparkSession, values: DataFrame, brackets: str) -> str:
    """Column value, an element or member a row, as a JSON Array or Object file of one value."""
    numbered = with_row_index(values, "row")
    last = values.count() - 1
    first = F.when(F.col("row") == 0, brackets[0]).otherwise(",")
    value = F.concat(first, "value", F.when(F.col("row") == last, brackets[1]).otherwise(""))
    return lines_file(spark, numbered.select(value.alias("value")), "x.json")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with commas and quotes, empty ones, numbers and text."""
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    blank = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"), blank.alias("kind"), "p_size")


PARTS = """SELECT p_partkey, p_name || ', "' || p_brand || '"' AS label, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS kind, p_size FROM part"""
TEXTS = f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, label, kind, CAST(p_size AS VARCHAR) AS p_size FROM ({PARTS})"


# --- CSV files


@query(TEXTS)
def csv_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, csv_file(spark, parts(spark, sf_dir))).batch()


@query(f"SELECT p_partkey, label FROM ({TEXTS}) WHERE CAST(p_size AS INT) > 25 AND lower(kind) <> 'promo'")
def csv_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table.open(spark, csv_file(spark, parts(spark, sf_dir)))
    return t.filter("p_size", Op.GreaterThan, "25").filter("kind", Op.NotEquals, "promo").delete("kind").delete("p_size").batch()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation ORDER BY nation.n_nationkey LIMIT 10 OFFSET 5")
def csv_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name").orderBy("n_nationkey")
    return Table.open(spark, csv_file(spark, nation)).page(5, 10)


@query('SELECT row_number() OVER (ORDER BY source_row) - 1 AS "row", source_row FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS source_row, p_size FROM part) WHERE p_size < 10')
def csv_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = csv_file(spark, parts(spark, sf_dir).orderBy("p_partkey"))
    return Table.open(spark, file).filter("p_size", Op.LessThan, "10").filtered_index()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || chr(10) || '\"' || n_regionkey AS n_name FROM nation")
def csv_file_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("n_name", F.lit('\n"'), "n_regionkey")
    return Table.open(spark, csv_file(spark, read(spark, sf_dir, "nation").select("n_nationkey", name.alias("n_name")))).batch()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a, n_name AS b, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'x' END AS c FROM nation WHERE n_nationkey > 0 UNION ALL SELECT '0', n_name, 'x' FROM nation WHERE n_nationkey = 0")
def csv_file_ragged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.when(F.col("n_nationkey") == 0, ",x").when(F.col("n_nationkey") % 2 == 0, "").otherwise(",x,more")
    lines = read(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat("n_nationkey", F.lit(","), "n_name", rest).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.csv", "a,b,c")).view()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a, '' AS \"Column2\", CAST(n_regionkey AS VARCHAR) AS c FROM nation")
def csv_file_blank_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.csv", "a, ,c")).batch()


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '\"' || p_name || ', \"\"' || p_brand || '\"\"\"' AS label FROM part")
def csv_file_literal_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = csv_file(spark, parts(spark, sf_dir).select("p_partkey", "label"))
    return Table.open(spark, file, quote_mode="literal").batch()


def schema_rows(spark: SparkSession, t: Table) -> DataFrame:
    rows = [(c.name, c.type.name, c.nullable) for c in t.schema.columns]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")


@query("SELECT * FROM (VALUES ('p_partkey', 'WholeNumber', false), ('mixed', 'FloatingPoint', true), ('flag', 'Boolean', false), ('day', 'Timestamp', false), ('odd', 'Text', false)) t(name, type, nullable)")
def csv_file_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types join to the least that covers them: whole and floating numbers, or text; a later blank makes a column nullable."""
    n = F.col("p_partkey")
    mixed = F.when(n % 5 == 0, "1.5").when((n % 11 == 0) & (n > 1), "").otherwise(n.cast("string"))
    odd = F.when(n % 13 == 0, "true").otherwise(n.cast("string"))
    frame = read(spark, sf_dir, "part", "p_partkey").orderBy("p_partkey").select("p_partkey", mixed.alias("mixed"), (n % 2 == 0).alias("flag"), F.lit("2024-01-31").alias("day"), odd.alias("odd"))
    return schema_rows(spark, Table.open(spark, csv_file(spark, frame), scope=None))


# --- JSON Lines files


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def jsonl_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With blank lines and lines of white space between the records."""
    frame = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    lines = Table.of(frame).json_lines().select(F.explode(F.array(F.col("value"), F.lit(""), F.lit(" \t"))).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.jsonl")).batch()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation ORDER BY nation.n_nationkey LIMIT 7 OFFSET 9")
def jsonl_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name").orderBy("n_nationkey")
    return Table.open(spark, json_file(spark, nation)).page(9, 7)


@query('SELECT row_number() OVER (ORDER BY c_custkey) AS "rec", \'{"c_custkey":\' || c_custkey || \'}\' AS value FROM customer')
def jsonl_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.numbered_lines(spark, json_file(spark, read(spark, sf_dir, "customer", "c_custkey").orderBy("c_custkey")))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events")
def jsonl_file_late_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key first seen after the records that the schema is inferred from is no column of a batch run."""
    numbered = with_row_index(read(spark, sf_dir, "events", "event_id").orderBy("event_id"), "row")
    late = F.when(F.col("row") > 300, ',"late":1').otherwise("")
    lines = numbered.select(F.concat(F.lit('{"event_id":'), "event_id", late, F.lit("}")).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.jsonl")).batch()


LEXEMES = '"a":1.50,"b":1e10,"c":9223372036854775808,"d":"5","e":"true","f":null,"h":{"x":[1.0, 2]},"é":"ü\\\\"'


@query(f"""SELECT '{{"n":' || n_nationkey || ',{LEXEMES}}}' AS value FROM nation""")
def jsonl_file_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, strings, nulls and nested values go from JSON to JSON as they are written; of a repeated key the first counts."""
    lines = read(spark, sf_dir, "nation").select(F.concat(F.lit('{"n":'), "n_nationkey", F.lit(f", {LEXEMES}" + ',"n":7}')).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.jsonl")).json_lines()


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN '{\"k\":' || n_nationkey || ',\"v\":1}' ELSE '{\"k\":' || n_nationkey || ',\"v\":\"\"}' END AS value FROM nation")
def jsonl_file_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys before an error are read; later ones are invalid, and written as empty strings."""
    end = F.when(F.col("n_nationkey") % 2 == 0, ',"v":1}').otherwise(',"v":')
    lines = read(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat(F.lit('{"k":'), "n_nationkey", end).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.jsonl")).json_lines()


@query("SELECT CAST(n AS VARCHAR) AS n, d FROM (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 = 0 THEN '1.5' WHEN n_nationkey % 3 = 1 THEN '1E+20' ELSE '123456789012' END AS d FROM nation)")
def json_number_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of 64 bits as they are, others as doubles."""
    n = F.col("n_nationkey")
    d = F.when(n % 3 == 0, "1.50").when(n % 3 == 1, "100000000000000000000").otherwise("123456789012")
    lines = read(spark, sf_dir, "nation").select(F.concat(F.lit('{"n":'), n, F.lit(',"d":'), d, F.lit("}")).alias("value"))
    return Table.open(spark, lines_file(spark, lines, "x.jsonl")).view()


# --- JSON Array and Object files


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as JSON objects in order of their keys."""
    frame = read(spark, sf_dir, "orders").orderBy("o_orderkey")
    return frame.select(F.to_json(F.struct("o_orderkey", "o_orderstatus", F.array(F.struct("o_custkey")).alias("by"))).alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, '[{\"o_custkey\":' || o_custkey || '}]' AS by FROM orders")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, json_value_file(spark, user_values(spark, sf_dir), "[]")).batch()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN '\"a, ]' || o_orderkey || '\"' ELSE '[' || o_orderkey || ',[]]' END AS value FROM orders")
def json_array_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by their place, primitives and strings with commas and brackets too."""
    key = F.col("o_orderkey")
    value = F.when(key % 3 == 0, F.concat(F.lit('"a, ]'), key, F.lit('"'))).otherwise(F.concat(F.lit("["), key, F.lit(",[]]")))
    values = read(spark, sf_dir, "orders").orderBy("o_orderkey").select(value.alias("value"))
    return readers.array_elements(spark, json_value_file(spark, values, "[]"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, '[Array: 1 items]' AS by FROM orders ORDER BY orders.o_orderkey LIMIT 20 OFFSET 30")
def json_array_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, json_value_file(spark, user_values(spark, sf_dir), "[]")).page(30, 20)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, 'c, ' || c_custkey AS key, '{\"n\": ' || c_nationkey || '}' AS value FROM customer")
def json_object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by their place; of a repeated key the last value."""
    member = F.concat(F.lit('"c, '), "c_custkey", F.lit('" : {"n": '), "c_nationkey", F.lit("}"))
    customers = read(spark, sf_dir, "customer").orderBy("c_custkey").select(member.alias("value"))
    again = with_row_index(customers, "row").where("row = 0").select("value")
    return readers.object_entries(spark, json_value_file(spark, customers.unionByName(again), "{}"))


def nations(spark: SparkSession, sf_dir: str) -> str:
    """A JSON Object file: {"regions": {"nations": [{"k", "name"}...]}, "n": 1}."""
    each = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    value = read(spark, sf_dir, "nation").agg(F.to_json(F.sort_array(F.collect_list(each))).alias("a"))  # 25 rows
    return lines_file(spark, value.select(F.concat(F.lit('{"regions": {"nations": '), "a", F.lit('}, "n": 1}')).alias("value")), "x.json")


@query("SELECT '[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || ']' AS \"#\", CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def drill_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.drill_node(spark, nations(spark, sf_dir), (Key("regions"), Key("nations"))).focused()


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) || ':0' AS \"#\", CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def drill_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.drill(spark, json_value_file(spark, user_values(spark, sf_dir), "[]"), (Key("by"),)).focused()


@query("SELECT row_number() OVER (ORDER BY n_nationkey) || '' AS \"#\", CASE WHEN n_nationkey % 2 = 0 THEN '<null>' ELSE CAST(n_nationkey AS VARCHAR) END AS v FROM nation")
def drill_null_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a JSON Lines file; a null at the path's end is a row."""
    v = F.when(F.col("n_nationkey") % 2 == 0, "null").otherwise(F.col("n_nationkey").cast("string"))
    lines = read(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat(F.lit('{"o":{"v":'), v, F.lit("}}")).alias("value"))
    return drilldown.drill(spark, lines_file(spark, lines, "x.jsonl"), (Key("o"), Key("v"))).focused()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, '[' || n_regionkey || ']' AS by FROM nation WHERE n_nationkey > 5")
def drill_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table to the tree of its file, into a drill-down, back to the tree, and to the table with its stack."""
    lines = read(spark, sf_dir, "nation").select(F.concat(F.lit('{"n_nationkey":'), "n_nationkey", F.lit(',"by":['), "n_regionkey", F.lit("]}")).alias("value"))
    file = lines_file(spark, lines, "x.jsonl")
    tree = drilldown.as_tree(spark, file, Table.open(spark, file).filter("n_nationkey", Op.GreaterThan, "5"))
    return tree.drill((Key("by"),)).back(spark).table().batch()


# --- dispatch, recipes, detection


@query("SELECT * FROM (VALUES ('csv', 'CSV', 'CSV'), ('jsonl', 'JSON Lines', 'JSON Lines'), ('array', 'JSON Array', 'refused'), ('object', 'JSON Object', 'refused')) t(file, interactive, batch)")
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    values = nation.select(F.concat(F.lit('{"k":'), "n_nationkey", F.lit("}")).alias("value"))
    files = {"csv": csv_file(spark, nation), "jsonl": json_file(spark, nation), "array": json_value_file(spark, values, "[]"), "object": nations(spark, sf_dir)}

    def batch(file: str) -> str:
        try:
            return readers.detect_batch(file).value
        except readers.SourceError:
            return "refused"

    return spark.createDataFrame([(k, readers.detect(spark, f).value, batch(f)) for k, f in files.items()], "file string, interactive string, batch string")


def batch_run(spark: SparkSession, file: str, recipe: str, out: str) -> DataFrame:
    """A batch run by the command line's own function; the lines that it wrote."""
    from tempfile import NamedTemporaryFile

    with NamedTemporaryFile("w", suffix=".yaml") as f:  # read by the driver only, before any task
        f.write(recipe)
        f.flush()
        target = f"{scratch(spark, 'files')}/out.{out}"
        if code := cli.main(["--cli", "--input", file, "--recipe", f.name, "--output", target], spark):
            raise RuntimeError(f"the run ended with {code}")
    return spark.read.text(target)


MASK = 'name: "m"\nactions:\n  - type: fill\n    columnName: "label"\n    value: "x"\n  - type: filter\n    columnName: "p_size"\n    operator: LessThan\n    value: "20"\n'


@query(f"SELECT p_partkey || ',x,' || CASE WHEN kind = '' THEN '\"\"' ELSE kind END || ',' || p_size AS value FROM ({PARTS}) WHERE p_size < 20 UNION ALL SELECT 'p_partkey,label,kind,p_size'")
def run_csv_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run(spark, csv_file(spark, parts(spark, sf_dir)), MASK, "csv")


@query(f"""SELECT '{{"p_partkey":' || p_partkey || ',"label":"x","kind":"' || kind || '","p_size":' || p_size || '}}' AS value FROM ({PARTS}) WHERE p_size < 20""")
def run_csv_to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run(spark, csv_file(spark, parts(spark, sf_dir)), MASK, "jsonl")


@query(f"SELECT p_partkey || ',x,' || CASE WHEN kind = '' THEN '\"\"' ELSE kind END || ',' || p_size AS value FROM ({PARTS}) WHERE p_size < 20 UNION ALL SELECT 'p_partkey,label,kind,p_size'")
def run_jsonl_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run(spark, json_file(spark, parts(spark, sf_dir)), MASK, "csv")


@query("SELECT c_custkey AS id, 'REDACTED' AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def recipe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempfile import TemporaryDirectory

    with TemporaryDirectory() as folder:  # written and read by the driver only
        recipes.save(recipes.parse(RECIPE), f"{folder}/r.yaml")
        return table(spark, sf_dir, "customer").replay(recipes.load(f"{folder}/r.yaml")).batch()


# --- stacks, schemas, rendering, navigation


@query("SELECT r_regionkey, r_name FROM region")
def clear_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region", "r_regionkey", "r_name").delete("r_name").rename("r_regionkey", "x").clear().batch()


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '<invalid>' END AS flag FROM part")
def view_render_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    flag = F.when(n == 0, " TRUE ").when(n == 1, "False").when(n == 2, "yes").otherwise("1")
    return Table.of(read(spark, sf_dir, "part").select("p_partkey", flag.alias("flag"))).cast("flag", LogicalType.Boolean).view()


@query("SELECT * FROM (VALUES ('r_regionkey', 'WholeNumber', true), ('r_name', 'Timestamp', true)) t(name, type, nullable)")
def schema_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "region", "r_regionkey", "r_name").schema
    changed = schema.updated("r_name", type=LogicalType.Timestamp).updated("r_regionkey", nullable=True).updated("none", nullable=False)
    return spark.createDataFrame([(c.name, c.type.name, c.nullable) for c in changed.columns], "name string, type string, nullable boolean")


@query("SELECT * FROM (VALUES ('a > [0][*] > b', 'b'), ('root', 'value'), ('a[*]', 'a')) t(path, column_name)")
def key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in an array is an index, whatever its name looks like."""
    paths = [drilldown.path_of([("object", "a"), ("object", "[0]"), ("array", "[1]"), ("object", "b")]), (), (Key("a"), Index())]
    return spark.createDataFrame([(drilldown.path_text(p), drilldown.column_name(p)) for p in paths], "path string, column_name string")


def blank(c: Column) -> Column:
    return scalars.is_blank(c)


@query("SELECT n_nationkey, n_nationkey % 3 <> 2 AS is_blank FROM nation")
def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.when(n % 3 == 0, " \t ").when(n % 3 == 1, F.lit(None).cast("string")).otherwise(" x")
    return read(spark, sf_dir, "nation").select("n_nationkey", blank(text).alias("is_blank"))


@query("SELECT c_custkey FROM customer ORDER BY customer.c_custkey LIMIT 15 OFFSET 30")
def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer", "c_custkey").orderBy("c_custkey")
    port = navigation.Viewport(0, 15, customers.count()).last().first().page_down().page_down()
    return port.rows(customers)


@query('SELECT row_number() OVER (ORDER BY event_id) - 1 AS "row", \'{"event_id":\' || event_id || \'}\' AS value FROM events ORDER BY "row" LIMIT 40 OFFSET 500')
def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a file's records by their places, from a store in which they are numbered once."""
    file = json_file(spark, read(spark, sf_dir, "events", "event_id").orderBy("event_id"))
    store = navigation.RowStore.build(readers.read_json_lines(spark, file).frame, scratch(spark, "rows"))
    return store.rows(500, 40)


@query('SELECT p AS "row", \'{"n_nationkey":\' || n_nationkey || \'}\' AS value FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS p, n_nationkey FROM nation) WHERE p IN (3, 4, 20)')
def row_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by their places, through a cache of windows."""
    file = json_file(spark, read(spark, sf_dir, "nation", "n_nationkey").orderBy("n_nationkey"))
    store = navigation.RowStore.build(readers.read_json_lines(spark, file).frame, scratch(spark, "rows"))
    cache = navigation.RowCache(store, capacity=6, window=4)
    found = [cache.get(k) for k in (3, 20, 4, 99)]
    return spark.createDataFrame([(r["row"], r["value"]) for r in found if r], "row long, value string")


@query("SELECT 'k,v' AS head, 'v\n' AS tail, NULL::VARCHAR AS beyond")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a file's bytes, and one that isn't in it."""
    lines = read(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit(",v")).alias("value"))
    file = ByteFile.open(spark, lines_file(spark, lines, "x.csv", "k,v"))
    row = (file.read(0, 3).decode(), file.read(file.length - 2, 2).decode(), file.try_read(file.length - 1, 2))
    return spark.createDataFrame([row], "head string, tail string, beyond string")


@query("SELECT n_nationkey, unnest(['n: ' || n_nationkey, 's: \"a\\\"b\\n\"', 'z: <null>', 'f: 1.50', 'o: {Object: 2 properties}', 'l: [Array: 0 items]', 'b: true']) AS node FROM nation")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers keep their decimals, and strings are quoted and escaped."""
    text = F.concat(F.lit('{"n":'), "n_nationkey", F.lit(',"s":"a\\"b\\n","z":null,"f":1.50,"o":{"x":1,"x":2},"l":[],"b":true}'))
    nodes = F.udf(lambda x: [t for _, _, t in navigation.children(x)], "array<string>")  # of the records on a screen
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(nodes(text)).alias("node"))


@query("SELECT n_nationkey, '{\"x\": [1.0, ' || n_nationkey || ' ]}' AS nested FROM nation")
def raw_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"a":1,"nested":{"x": [1.0, '), "n_nationkey", F.lit(' ]}, "nested":2}'))
    found: Callable[[str], str] = lambda x: jsontext.find(x, ["nested"])[0][1]
    return read(spark, sf_dir, "nation").select("n_nationkey", F.udf(found, "string")(text).alias("nested"))
