"""One query per operator over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.inference import infer_whole
from sparkloom.functions.predicates import Operator as Op
from sparkloom.operators import drilldown, execute, navigation
from sparkloom.operators.drilldown import Index, Key
from sparkloom.operators.table import Table
from sparkloom.plans import recipe as recipes
from sparkloom.sources.readers import union_schema, with_row_index
from sparkloom.sources.records import JsonRecords
from sparkloom.streaming import replay
from sparkloom.types import DataFormat, LogicalType, TableSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Table:
    return Table.of(read(spark, sf_dir, name, *columns))


# --- the action stack


@query("SELECT c_custkey AS id, c_name AS label, c_nationkey FROM customer")
def rename_delete_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return t.rename("c_custkey", "id").rename("c_name", "name").rename("name", "label").delete("c_acctbal").delete("unknown").batch()


@query("SELECT c_custkey, 'REDACTED' AS c_name, c_mktsegment FROM customer")
def fill_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").fill("c_name", "REDACTED").batch()


@query("SELECT n_nationkey AS n_name, n_regionkey FROM nation")
def rename_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").rename("n_nationkey", "n_name").batch()


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def format_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").format_timestamp("o_orderdate", "yyyy-MM-dd").batch()


@query("SELECT o_orderkey, strftime(o_orderdate, '%A, %d %B %Y %I:%M %p') AS o_orderdate FROM orders")
def format_ts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").format_timestamp("o_orderdate", "dddd, dd MMMM yyyy hh:mm tt").batch()


@query("SELECT o_orderkey, '0' AS o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return t.fill("o_orderstatus", "0").filter("o_orderstatus", Op.Equals, "f").batch()


@query("SELECT c_name FROM customer WHERE c_nationkey = 7")
def filter_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer", "c_name", "c_nationkey")
    return t.filter("c_nationkey", Op.Equals, "7").delete("c_nationkey").filter("c_nationkey", Op.Equals, "8").batch()


@query("SELECT c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer WHERE try_cast(CAST(c_acctbal AS VARCHAR) AS DOUBLE) > 5000")
def cast_text_to_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal").withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    return Table.of(text).cast("c_acctbal", LogicalType.FloatingPoint).filter("c_acctbal", Op.GreaterThan, "5,000").batch()


@query("SELECT c_custkey, c_name FROM customer WHERE false")
def cast_unparsable_is_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").cast("c_name", LogicalType.WholeNumber).filter("c_name", Op.GreaterThan, "0").batch()


# --- filters


def _filter(name: str, source: str, columns: tuple[str, ...], column: str, op: Op, value: str, where: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source, *columns).filter(column, op, value).batch()

    QUERIES[name], ORACLE[name] = f, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}"


for _name, _op, _sign in (("gt", Op.GreaterThan, ">"), ("lt", Op.LessThan, "<"), ("ge", Op.GreaterThanOrEqual, ">="), ("le", Op.LessThanOrEqual, "<=")):
    _filter(f"filter_{_name}_long", "lineitem", ("l_orderkey", "l_linenumber"), "l_linenumber", _op, " 3 ", f"l_linenumber {_sign} 3")
    _filter(f"filter_{_name}_double", "orders", ("o_orderkey", "o_totalprice"), "o_totalprice", _op, "150,000.5", f"o_totalprice {_sign} 150000.5")
    _filter(f"filter_{_name}_ts", "orders", ("o_orderkey", "o_orderdate"), "o_orderdate", _op, "6/15/1995", f"o_orderdate {_sign} TIMESTAMP '1995-06-15'")
for _name, _op, _value, _where in (
    ("equals", Op.Equals, "PROMO", "lower(p_type) = 'promo'"),
    ("not_equals", Op.NotEquals, "PROMO", "lower(p_type) <> 'promo'"),
    ("contains", Op.Contains, "O", "contains(lower(p_type), 'o')"),
    ("not_contains", Op.NotContains, "O", "NOT contains(lower(p_type), 'o')"),
    ("starts_with", Op.StartsWith, "s", "starts_with(lower(p_type), 's')"),
    ("ends_with", Op.EndsWith, "D", "ends_with(lower(p_type), 'd')"),
):
    _filter(f"filter_{_name}_text", "part", ("p_partkey", "p_type"), "p_type", _op, _value, _where)
_filter("filter_text_on_number", "part", ("p_partkey", "p_size"), "p_size", Op.StartsWith, "1", "starts_with(CAST(p_size AS VARCHAR), '1')")
_filter("filter_text_order_is_empty", "customer", ("c_custkey", "c_name"), "c_name", Op.GreaterThan, "A", "false")
_filter("filter_bad_literal_is_empty", "customer", ("c_custkey", "c_acctbal"), "c_acctbal", Op.GreaterThan, "many", "false")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_linenumber >= 2 AND l_quantity < 25 AND l_shipdate > TIMESTAMP '1995-01-01'")
def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return t.filter("l_linenumber", Op.GreaterThanOrEqual, "2").filter("l_quantity", Op.LessThan, "25").filter("l_shipdate", Op.GreaterThan, "1995-01-01").batch()


# --- typed rendering


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS c_acctbal, '<invalid>' AS c_name FROM customer")
def view_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_name").cast("c_name", LogicalType.WholeNumber).view()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, '<invalid>' AS o_orderstatus FROM orders")
def view_render_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return Table.of(text).cast("o_orderdate", LogicalType.Timestamp).cast("o_orderstatus", LogicalType.Boolean).view()


@query("SELECT unnest(['r_regionkey (number)', 'region (text)']) AS header")
def view_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(h,) for h in table(spark, sf_dir, "region").rename("r_name", "region").headers()], "header string")


# --- output lines


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"fixed":7}' AS value FROM nation""")
def to_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "nation").withColumn("fixed", F.lit(""))
    return Table.of(frame).rename("n_name", "name").fill("fixed", "007").json_lines()


@query("""SELECT p_partkey || ',' || CASE WHEN contains(p_name, ',') OR contains(p_name, '"') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',"a,""b"' AS value FROM part""")
def to_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").fill("p_brand", 'a,"b').csv_lines()[1]


@query("""SELECT '{"k":' || CAST(props->>'$.k' AS VARCHAR) || '}' AS value FROM events""")
def json_to_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir).json_lines()


# --- JSON cells


def props(spark: SparkSession, sf_dir: str, *more: tuple[str, LogicalType]) -> Table:
    lines = read(spark, sf_dir, "events", "props").select(F.col("props").alias("value"))
    return Table(JsonRecords(lines, TableSchema.of([("k", LogicalType.WholeNumber, False), *[(n, t, True) for n, t in more]], DataFormat.JsonLines)))


@query("SELECT props->>'$.k' AS k, NULL::VARCHAR AS absent FROM events")
def json_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir, ("absent", LogicalType.Text)).batch()


@query("SELECT props->>'$.k' AS k, '<null>' AS absent FROM events")
def json_missing_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir, ("absent", LogicalType.Text)).view()


@query("SELECT props->>'$.k' AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 50")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir).filter("k", Op.GreaterThan, "50").batch()


@query("SELECT props->>'$.k' AS k, NULL::VARCHAR AS absent FROM events WHERE false")
def json_filter_on_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir, ("absent", LogicalType.Text)).filter("absent", Op.NotEquals, "x").batch()


@query("SELECT '{Object: ' || len(json_keys(props)) || ' properties}' AS p, '[Array: 2 items]' AS a FROM events")
def json_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "events", "props").select(F.concat(F.lit('{"p":'), "props", F.lit(',"a":['), "props", F.lit(",1]}")).alias("value"))
    return Table(JsonRecords(lines, TableSchema.of([("p", LogicalType.JsonObject, False), ("a", LogicalType.JsonArray, False)], DataFormat.JsonLines))).view()


# --- drill-down


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON record per user: {"orders": [{"id", "t"}...], "tags": [...]}, in order of event_id."""
    events = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t")))).alias("orders"))
    return events.select(F.col("user_id").alias("rec"), F.to_json(F.struct("orders", F.col("orders.t").alias("tags"))).alias("value"))


PLACED = "row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1"


@query("SELECT 'r' || event_id AS \"#\", props->>'$.k' AS k FROM events")
def drill_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "events", "event_id", "props").select(F.concat(F.lit("r"), "event_id").alias("rec"), F.concat(F.lit('{"user":'), "props", F.lit("}")).alias("value"))
    return drilldown.drill_records(records, (Key("user"),), DataFormat.JsonLines).focused()


@query("SELECT CAST(event_id AS VARCHAR) AS \"#\", props->>'$.k' AS k FROM events")
def drill_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "events", "event_id", "props").select(F.col("event_id").alias("rec"), F.concat(F.lit('{"user":'), "props", F.lit("}")).alias("value"))
    return drilldown.drill_records(records, (Key("user"), Key("k")), DataFormat.JsonLines).focused()


@query(f"SELECT user_id || ':' || ({PLACED}) AS \"#\", CAST(event_id AS VARCHAR) AS id, event_type AS t FROM events")
def drill_array_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.drill_records(users(spark, sf_dir), (Key("orders"),), DataFormat.JsonLines).focused()


@query(f"SELECT user_id || ':' || ({PLACED}) AS \"#\", event_type AS value FROM events")
def drill_array_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.drill_records(users(spark, sf_dir), (Key("tags"), Index("[0]")), DataFormat.JsonLines).focused()


@query(f"SELECT user_id || ':' || ({PLACED}) AS \"#\", event_type AS t FROM events")
def drill_through_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.drill_records(users(spark, sf_dir), (Key("orders"), Index(), Key("t")), DataFormat.JsonLines).focused()


@query("SELECT 'k' AS key, 'WholeNumber' AS types, count(*) AS n FROM events")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "events", "props").select(F.col("props").alias("value"))
    return union_schema(lines).select("key", F.concat_ws(",", "types").alias("types"), "n")


@query("SELECT * FROM (VALUES ('l_orderkey', 'WholeNumber', false), ('l_quantity', 'FloatingPoint', false), ('l_returnflag', 'Text', false), ('l_shipdate', 'Timestamp', false)) t(name, type, nullable)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    found = infer_whole(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]))
    return spark.createDataFrame([(c, t.name, null) for c, (t, null) in found.items()], "name string, type string, nullable boolean")


# --- navigation


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation LIMIT 10 OFFSET 5")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").page(5, 10)


@query('SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "row", c_custkey - (SELECT min(c_custkey) FROM customer) AS source_row FROM customer WHERE c_nationkey < 5')
def filtered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").filter("c_nationkey", Op.LessThan, "5").filtered_index()


@query('SELECT (c_custkey - (SELECT min(c_custkey) FROM customer)) // 1000 AS "range", min(c_custkey - (SELECT min(c_custkey) FROM customer)) AS "first", count(*) AS n FROM customer GROUP BY 1')
def record_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.ranges(read(spark, sf_dir, "customer", "c_custkey"))


@query('SELECT c_custkey, c_custkey - (SELECT min(c_custkey) FROM customer) AS "row" FROM customer')
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(read(spark, sf_dir, "customer", "c_custkey"))


# --- recipes

RECIPE = """name: "customers in debt"
actions:
  - type: rename
    oldName: "c_custkey"
    newName: "id"
  - type: fill
    columnName: "c_name"
    value: "REDACTED"
  - type: filter
    columnName: "c_acctbal"
    operator: LessThan
    value: "0"
  - type: delete
    columnName: "c_mktsegment"
"""


@query("SELECT c_custkey AS id, 'REDACTED' AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def recipe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").replay(recipes.parse(RECIPE)).batch()


@query("SELECT c_custkey AS id, 'REDACTED' AS c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def recipe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = recipes.from_json(recipes.to_json(recipes.parse(recipes.serialize(recipes.parse(RECIPE)))))
    return replay(read(spark, sf_dir, "customer"), again)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute.to_frame((t := table(spark, sf_dir, "customer")).records, t.replay(recipes.parse(RECIPE)).plan())
