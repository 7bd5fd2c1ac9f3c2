"""Drill-down: a path into nested JSON, followed in every record, becomes a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import jsontext
from sparkloom.operators.table import Table
from sparkloom.sources import readers
from sparkloom.sources.records import JsonRecords, find_cells
from sparkloom.types import DataFormat, LogicalType, TableSchema, join_all


class DrillDownError(ValueError):
    """A path that leads to no table."""


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Index:
    """An element of an array; all of its elements are followed, whichever it names."""

    label: str = "*"


Path = tuple[Key | Index, ...]


def path_of(nodes: list[tuple[str, str]]) -> Path:
    """From (kind of parent, name) pairs of a selected node and those above it, outermost first: what stands in an array is an index, whatever its name looks like."""
    return tuple(Index(name) if parent == "array" else Key(name) for parent, name in nodes)


def path_text(path: Path) -> str:
    text = ""
    for x in path:
        text += "[*]" if isinstance(x, Index) else f" > {x.name}" if text else x.name
    return text or "root"


def column_name(path: Path) -> str:
    """The column of values that aren't objects: the last key, or value."""
    return next((x.name for x in reversed(path) if isinstance(x, Key)), "value")


def _step(value: jsontext.Value, key: str) -> jsontext.Value | None:
    if value.kind != "object":
        return None
    return next((v for k, v in jsontext.members(value.raw) if k == key), None)


def follow(text: str, path: Path, record: str) -> Iterator[tuple[str, str, bool]]:
    """A record's rows: (label, object as JSON, whether it was made for a value that is none). A trailing index is the array before it."""
    steps = path[:-1] if path and isinstance(path[-1], Index) else path
    try:
        start, _ = jsontext.value_at(text, jsontext.SPACE.match(text).end())
        at = [(record, start)]
        for x in steps:
            if isinstance(x, Key):
                at = [(label, v) for label, value in at if (v := _step(value, x.name)) is not None]
            else:
                at = [(f"{label}:{k}", v) for label, value in at if value.kind == "array" for k, v in enumerate(jsontext.elements(value.raw))]
        for label, value in at:
            if value.kind == "object":
                yield label, value.raw, False
            elif value.kind == "array":
                for k, v in enumerate(jsontext.elements(value.raw)):
                    yield f"{label}:{k}", v.raw if v.kind == "object" else f'{{"value":{jsontext.source(v)}}}', v.kind != "object"
            else:
                yield label, f"{{{jsontext.source(jsontext.Value('string', _raw_key(column_name(path))))}:{jsontext.source(value)}}}", True
    except jsontext.Malformed:
        return


def _raw_key(name: str) -> str:
    return name.replace("\\", "\\\\").replace('"', '\\"')


ROWS = "array<struct<label:string,value:string,scalar:boolean,types:array<struct<key:string,type:string>>>>"


def rows_of(records: DataFrame, path: Path, typed: bool = False) -> DataFrame:
    """records (rec, value) to (rec, k, label, value, scalar); the work is a task's own, and rows keep the records' order.

    typed: with the keys of each row's object and the names of their values' types, found in the same call.
    """

    def found(lines: pa.Array, record: pa.Array) -> pa.Array:
        out = []
        for line, r in zip(lines.to_pylist(), record.to_pylist(), strict=True):
            rows = follow(line or "", path, str(r))
            if typed:
                out.append([{"scalar": c, "types": [{"key": k, "type": t} for k, t in jsontext.types(b)]} for _, b, c in rows])
            else:
                out.append([{"label": a, "value": b, "scalar": c} for a, b, c in rows])
        return pa.array(out, pa.list_(STRUCT))

    exploded = records.select("rec", F.posexplode(F.arrow_udf(found, ROWS)("value", F.col("rec").cast("string"))).alias("k", "r"))
    return exploded.select("rec", "k", "r.scalar", "r.types") if typed else exploded.select("rec", "k", "r.label", "r.value", "r.scalar")


STRUCT = pa.struct([("label", pa.string()), ("value", pa.string()), ("scalar", pa.bool_()), ("types", pa.list_(pa.struct([("key", pa.string()), ("type", pa.string())])))])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rec, value): lines by their place from 1; blank ones count but have no row."""
    lines = readers.with_row_index(spark.read.text(path).select(F.regexp_replace("value", f"^{readers.BOM}", "").alias("value")), "row")
    return lines.select((F.col("row") + 1).alias("rec"), "value").where(F.col("value").rlike(r"\S"))


def aggregate_schema(rows: DataFrame, format: DataFormat) -> TableSchema:
    """The union of the rows' keys in the order they are first seen. Nulls, and values that aren't in an object, give no type; without any a column is text.

    rows as rows_of() gives them when typed. One pass: an entry without a key stands for each row, so rows are counted with the keys.
    """
    row = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("").alias("type")))
    keyed = rows.select("rec", "k", "scalar", F.posexplode(F.concat(row, "types")).alias("at", "t"))
    votes = F.when(~F.col("scalar"), F.col("t.type"))
    seen = keyed.groupBy(F.col("t.key").alias("key")).agg(
        F.collect_set(votes).alias("types"),
        F.count(F.when(F.col("scalar"), "").otherwise(F.col("t.type"))).alias("n"),
        F.min(F.struct("rec", "k", "at")).alias("first"),
    )
    found = seen.orderBy("first").collect()  # a row per key
    total = sum(r.n for r in found if r.key is None)
    if not total:
        raise DrillDownError("The path leads to no rows")
    kind = lambda types: join_all([LogicalType[t] for t in sorted(types)]) if types else LogicalType.Text
    columns = [(r.key, kind(r.types), r.n < total) for r in found if r.key is not None]
    if not columns:
        raise DrillDownError("The path leads to no columns")
    return TableSchema.of(columns, format)


@dataclass(frozen=True)
class Tree:
    """A file shown as a tree of its records; table() and tree() of a JSON Lines table are two views of the same records."""

    spark: SparkSession
    file: str
    actions: tuple = ()

    @classmethod
    def open(cls, spark: SparkSession, file: str) -> Tree:
        format = readers.detect(spark, file)
        if format is DataFormat.Csv:
            raise DrillDownError("A CSV file has no tree")
        return cls(spark, file)

    def roots(self) -> DataFrame:
        """(pos, label, value): the nodes at the top: lines by their number from 1, elements by their place, members by their key."""
        format = readers.detect(self.spark, self.file)
        if format is DataFormat.JsonLines:
            return numbered_lines(self.spark, self.file).select(F.col("rec").alias("pos"), F.col("rec").cast("string").alias("label"), "value")
        if format is DataFormat.JsonArray:
            found = readers.array_elements(self.spark, self.file)
            return found.select("pos", F.concat(F.lit("["), "pos", F.lit("]")).alias("label"), "value")
        return readers.object_entries(self.spark, self.file).select("pos", F.col("key").alias("label"), "value")

    def table(self) -> Table:
        """The same records as a table, with the stack that they had as one; of JSON Lines only."""
        if readers.detect(self.spark, self.file) is not DataFormat.JsonLines:
            raise DrillDownError("Only JSON Lines can be shown as a table and as a tree")
        return Table.open(self.spark, self.file).then(*self.actions)

    def drill(self, path: Path) -> DrilledTable:
        """The table that a path leads to; back() of it is this tree."""
        if readers.detect(self.spark, self.file) is DataFormat.JsonObject:
            return replace(drill_node(self.spark, self.file, path), parent=self)
        return replace(drill(self.spark, self.file, path), parent=self)


def as_tree(spark: SparkSession, file: str, table: Table) -> Tree:
    """A JSON Lines table as a tree of its records; its stack comes back with table()."""
    if table.schema.format is not DataFormat.JsonLines:
        raise DrillDownError("Only JSON Lines can be shown as a table and as a tree")
    return Tree(spark, file, table.actions)


@dataclass(frozen=True)
class DrilledTable(Table):
    """A table with the position label of each row; parent is where it came from: a file, or a table and the mode that showed it."""

    parent: object = None

    def back(self, spark: SparkSession) -> Table | Tree:
        """What was shown before the drill-down, with its stack of actions and its mode."""
        return Tree.open(spark, self.parent) if isinstance(self.parent, str) else self.parent

    def focused(self) -> DataFrame:
        """The label in column #, then the cells as shown."""
        names = [c.name for c in self.schema.columns]
        cells = self.records.frame.withColumn("cells", find_cells(names)("value"))
        return cells.select(F.col("label").alias("#"), *[F.col("cells")[k]["shown"].alias(n) for k, n in enumerate(names)])


def drill_records(records: DataFrame, path: Path, format: DataFormat, parent: object = None) -> DrilledTable:
    schema = aggregate_schema(rows_of(records, path, typed=True), format)
    return DrilledTable(JsonRecords(rows_of(records, path), schema), parent=parent)


def drill(spark: SparkSession, file: str, path: Path) -> DrilledTable:
    """Follows the path in every record of a JSON Lines or JSON Array file."""
    format = readers.detect(spark, file)
    if format is DataFormat.JsonLines:
        return drill_records(numbered_lines(spark, file), path, format, file)
    if format is DataFormat.JsonArray:
        return drill_records(readers.array_elements(spark, file).select(F.col("pos").alias("rec"), "value"), path, format, file)
    raise DrillDownError(f"Full aggregation needs JSON Lines or a JSON Array, not {format.value}")


def drill_node(spark: SparkSession, file: str, path: Path) -> DrilledTable:
    """Turns one array of objects in a JSON Object file into a table."""
    if not path or not isinstance(path[0], Key):
        raise DrillDownError("The path must start with a key")
    node = readers.object_entries(spark, file).where(F.col("key") == path[0].name).select("value")
    found = node.select(F.arrow_udf(lambda values: pa.array([_items(x, path[1:]) for x in values.to_pylist()], NODE), NODE_TYPE)("value").alias("n"))
    problem = found.select("n.problem").first()
    if problem is None or problem.problem:
        raise DrillDownError(problem.problem if problem else NOWHERE)
    rows = found.select(F.lit(0).cast("long").alias("rec"), F.posexplode("n.items").alias("k", "value"), F.lit(False).alias("scalar"))
    typed = rows.select("rec", "k", "scalar", readers.key_types(F.col("value")).alias("types"))
    typed = typed.withColumn("types", F.transform("types", lambda t: F.struct(t["key"].alias("key"), t["type"].alias("type"))))
    labelled = rows.withColumn("label", F.concat(F.lit("["), "k", F.lit("]")))
    return DrilledTable(JsonRecords(labelled, aggregate_schema(typed, DataFormat.JsonObject)), parent=file)


NOWHERE = "The path leads nowhere"
NODE, NODE_TYPE = pa.struct([("problem", pa.string()), ("items", pa.list_(pa.string()))]), "struct<problem:string,items:array<string>>"


def _items(text: str, path: Path) -> dict[str, object]:
    """The objects of the array that the path leads to from a value, or what is wrong with it; a task's own work."""
    value: jsontext.Value | None = jsontext.value_at(text, 0)[0]
    for x in path:
        if value is not None and isinstance(x, Key):
            value = _step(value, x.name)
        elif value is not None:
            found = list(jsontext.elements(value.raw)) if value.kind == "array" else []
            place = x.label.strip("[]")
            value = found[int(place)] if place.isdigit() and int(place) < len(found) else None
    if value is None:
        return {"problem": NOWHERE}
    if value.kind != "array":
        return {"problem": "Only an array can be drilled into here"}
    items = list(jsontext.elements(value.raw))
    if not items:
        return {"problem": "The array is empty"}
    if any(v.kind != "object" for v in items):
        return {"problem": "The array has elements that are not objects"}
    return {"items": [v.raw for v in items]}
