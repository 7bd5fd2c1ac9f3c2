"""Files to records: detection, CSV, JSON Lines, JSON Array and JSON Object."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import jsontext
from sparkloom.functions.inference import infer_text, infer_token, infer_whole
from sparkloom.sources.pieces import array_elements, object_entries  # noqa: F401
from sparkloom.sources.pinned import pinned
from sparkloom.sources.records import JsonRecords, TextRecords
from sparkloom.sources.scratch import scratch
from sparkloom.types import DataFormat, LogicalType, TableSchema, join_all, join_types

#: Records that a schema is inferred from unless the whole file is asked for.
HEAD = 200
BOM = "﻿"


class SourceError(ValueError):
    """A file that can't be read as what it should be."""


# --- detection


def detect(spark: SparkSession, path: str) -> DataFormat:
    """By the extension; .json by its first character."""
    lower = path.lower()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise SourceError(f"File not found: {path}")
    if fs.getContentSummary(fs_path).getLength() == 0:
        raise SourceError(f"File is empty: {path}")
    if lower.endswith(".csv"):
        return DataFormat.Csv
    if lower.endswith(".jsonl"):
        return DataFormat.JsonLines
    if not lower.endswith(".json"):
        raise SourceError(f"Unsupported file format: {path}")
    first = spark.read.option("lineSep", ",").text(path).select(F.regexp_extract("value", rf"^[{BOM}\s]*(\S)", 1).alias("c")).where("c <> ''").limit(1).collect()
    formats = {"[": DataFormat.JsonArray, "{": DataFormat.JsonObject}
    if not first or first[0].c not in formats:
        raise SourceError(f"Neither an array nor an object: {path}")
    return formats[first[0].c]


def detect_batch(path: str) -> DataFormat:
    lower = path.lower()
    if lower.endswith(".csv"):
        return DataFormat.Csv
    if lower.endswith(".jsonl"):
        return DataFormat.JsonLines
    if lower.endswith(".json"):
        raise SourceError(f"JSON Array and JSON Object files are not supported in batch mode: {path}")
    raise SourceError(f"Unsupported file format: {path}")


# --- row numbers


def is_settled(df: DataFrame) -> bool:
    """Whether all plans over df find the same rows in the same partitions: none is dealt out by a shuffle.

    The bounds of a sort are sampled anew for each plan, and how shuffled partitions are put together follows from the
    bytes of the columns that a plan keeps. The small side of a broadcast join deals out nothing.
    """
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "BroadcastExchange":
            continue
        if name.endswith("Exchange"):
            return False
        if name == "AdaptiveSparkPlan":
            nodes.append(node.initialPlan())
        below = node.children()
        nodes += [below.apply(k) for k in range(below.size())]
    return True


def settled(df: DataFrame) -> DataFrame:
    """df, kept as a checkpoint with its order and partitions if a shuffle deals out its rows."""
    if is_settled(df):
        return df
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "rows"))
    return df.checkpoint()


def with_row_index(df: DataFrame, name: str = "row") -> DataFrame:
    """Adds each row's place from 0 in the frame's order: places in its partition, after the sizes of those before.

    Two passes and no shuffle of rows; only partition sizes are summed. Both passes have to find the same partitions, so a
    frame that comes from a shuffle, such as a sorted one, is kept first, and the parts of files are cut once.
    """
    marked = pinned(settled(df)).withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return marked.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before")


def rows_at(df: DataFrame, first: int, n: int) -> DataFrame:
    """n rows from a place on, in the frame's order; a plain limit takes what comes first from the executors."""
    return df.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").offset(first).limit(n).drop("__at")


# --- CSV


def is_multi_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether some line has an odd number of quotes, so that a record may span lines. A pass that any number of tasks share; files without such a line stay splittable."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.option("encoding", encoding).text(path).where(quotes % 2 == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, scope: int | None = HEAD, sep: str = ",", quote_mode: str = "unquote", multi_line: bool | None = None, encoding: str = "UTF-8") -> TextRecords:
    """quote_mode: "unquote" reads quoted fields as RFC 4180 does; "literal" keeps the quotes in the cells. scope: records to infer from (None: all)."""
    if quote_mode == "literal":
        return _csv_literal(spark, path, scope, sep)
    multi = is_multi_line(spark, path, encoding) if multi_line is None else multi_line
    reader = spark.read.options(sep=sep, quote='"', escape='"', multiLine=multi, encoding=encoding, mode="PERMISSIVE", enforceSchema=True)
    head = reader.csv(path, header=False).limit(1).collect()
    if not head:
        raise SourceError("CSV file has no columns")
    names = [(x or "").removeprefix(BOM) if k == 0 else x or "" for k, x in enumerate(head[0])]
    physical = [f"c{k}" for k in range(len(names))]
    frame = reader.options(columnNameOfCorruptRecord="bad").schema(", ".join([*[f"{c} string" for c in physical], "bad string"])).csv(path, header=True)
    empty = [F.coalesce(c, F.when(F.col("bad").isNull(), "")).alias(c) for c in physical]
    return _csv_records(frame.select(*empty, "bad"), names, physical, scope)


def _csv_literal(spark: SparkSession, path: str, scope: int | None, sep: str) -> TextRecords:
    # a separator and what follows it up to the next one outside of quotes, in one pass over the line
    one = re.escape(sep)
    pattern = rf'{one}((?:[^"{one}]++|"[^"]*+"|"[^"]*+$)*+)'
    fields = F.regexp_extract_all(F.concat(F.lit(sep), "value"), F.lit(pattern), 1)
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"))
    numbered = with_row_index(lines)
    head = numbered.where("row = 0").select(fields.alias("f")).collect()
    if not head:
        raise SourceError("CSV file has no columns")
    names = list(head[0].f)
    physical = [f"c{k}" for k in range(len(names))]
    split = numbered.where("row > 0 AND value <> ''").select("value", fields.alias("f"))
    frame = split.select(*[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(physical)], F.when(F.size("f") != len(names), F.col("value")).alias("bad"))
    return _csv_records(frame, names, physical, scope)


def _csv_records(frame: DataFrame, names: list[str], physical: list[str], scope: int | None) -> TextRecords:
    schema_names = [n if n.strip() else f"Column{k + 1}" for k, n in enumerate(names)]
    columns = {s: p if n.strip() else None for s, n, p in zip(schema_names, names, physical, strict=True)}
    TableSchema.of([(n, LogicalType.Text, True) for n in schema_names], DataFormat.Csv)  # refuses names that repeat
    rows = frame.limit(HEAD if scope is None else scope).collect()
    types = csv_head_types(rows, len(physical))
    if scope is None and rows:
        whole = infer_whole(frame.where("bad IS NULL").select(*physical))
        types = [(LogicalType.Text if not (rows[0][k] or "").strip() else whole[c][0], whole[c][1]) for k, c in enumerate(physical)]
    return TextRecords(frame, TableSchema.of([(n, *t) for n, t in zip(schema_names, types, strict=True)], DataFormat.Csv), columns, "bad")


def csv_head_types(rows: list[Row], width: int) -> list[tuple[LogicalType, bool]]:
    """From the first rows: a blank in the first makes text, a later blank only nullable; rows of another length count for nothing."""
    if not rows:
        return [(LogicalType.Text, True)] * width
    if rows[0]["bad"] is not None:
        raise SourceError("The first row has another number of fields than the header")
    good = [r for r in rows if r["bad"] is None]
    out = []
    for k in range(width):
        cells = [r[k] or "" for r in good]
        types = [infer_text(x) for x in cells if x.strip()]
        out.append((LogicalType.Text if not cells[0].strip() else join_all(types), any(not x.strip() for x in cells)))
    return out


# --- JSON Lines


def read_json_lines(spark: SparkSession, path: str, scope: int | None = HEAD) -> JsonRecords:
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("value"))
    return json_records(lines, scope, DataFormat.JsonLines)


def json_records(lines: DataFrame, scope: int | None, format: DataFormat) -> JsonRecords:
    head = [r.value for r in lines.limit(HEAD if scope is None else scope).collect()]
    columns = json_head_types(head)
    if scope is None:
        columns = _widened(columns, lines)
    return JsonRecords(lines, TableSchema.of([(k, *t) for k, t in columns.items()], format))


def json_head_types(lines: list[str]) -> dict[str, tuple[LogicalType, bool]]:
    """Keys in the order they are first seen. A null seen first makes text; keys that some object lacks, or that come late, are nullable."""
    seen: dict[str, tuple[LogicalType, bool]] = {}
    started = False
    for line in lines:
        try:
            found = {}
            for key, value in jsontext.members(line):
                found.setdefault(key, infer_token(value.kind, value.raw))
        except jsontext.Malformed:
            continue
        for key, type in found.items():
            if key not in seen:
                seen[key] = (type or LogicalType.Text, started or type is None)
            elif type is None:
                seen[key] = (seen[key][0], True)
            else:
                seen[key] = (join_types(seen[key][0], type), seen[key][1])
        for key in seen:
            if key not in found:
                seen[key] = (seen[key][0], True)
        started = True
    if not seen:
        raise SourceError("No JSON object to infer a schema from")
    return seen


def _key_types(lines: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "type": t, "at": at} for at, (k, t) in enumerate(jsontext.types(x or ""))] for x in lines])


def key_types(line: Column) -> Column:
    """Each line's keys, their values' types and their places."""
    return F.pandas_udf(_key_types, "array<struct<key:string,type:string,at:int>>")(line)


def union_schema(lines: DataFrame) -> DataFrame:
    """(key, types, n, first): the union of the objects' keys; a row per key and task is shuffled."""
    keyed = lines.withColumn("__at", F.monotonically_increasing_id()).select("__at", F.explode(key_types(F.col("value"))).alias("k"))
    return keyed.groupBy(F.col("k.key").alias("key")).agg(F.collect_set("k.type").alias("types"), F.count("k.type").alias("n"), F.min(F.struct("__at", "k.at")).alias("first"))


def _widened(columns: dict[str, tuple[LogicalType, bool]], lines: DataFrame) -> dict[str, tuple[LogicalType, bool]]:
    total = lines.where(F.col("value").rlike(r"\S")).count()
    out = dict(columns)
    for r in union_schema(lines).orderBy("first").collect():  # a row per key
        types = [LogicalType[t] for t in sorted(r.types)]
        before = [out[r.key][0]] if r.key in out else []
        late = r.key not in out
        out[r.key] = (join_all([*before, *types]) if before or types else LogicalType.Text, late or out[r.key][1] or r.n < total)
    return out


# --- JSON arrays and objects


def read_json_array(spark: SparkSession, path: str, scope: int | None = HEAD) -> JsonRecords:
    return json_records(array_elements(spark, path).select("value"), scope, DataFormat.JsonArray)
