"""JSON Array and JSON Object files, cut into their elements or members by many tasks.

A file is read in pieces between commas, which Spark's text reader splits like lines, so neither the file nor a line of
it has to fit in a task. Where a task's part starts it can't be told whether that is within a string or how deep, so a
first pass sums up each part for both cases: how it ends, how much deeper, and how many commas it has at each depth.
From these sums, a row for each part, follows how each part starts, and a second pass cuts it at the commas of depth 1.
What lies between two of these is whole in a part, or is put together from the parts that it spans. Both passes have to
find the same parts, so these are cut once, not anew in each plan by the cores that there are just then.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import jsontext
from sparkloom.sources.pinned import pinned

QUOTE, ESCAPE, COMMA, OPENING, CLOSING = 34, 92, 44, (91, 123), (93, 125)
BOM = "﻿"


class PieceError(ValueError):
    """A file that isn't one JSON array or object."""


@dataclass
class Scan:
    """What a text holds if it starts within a string or not, and at a depth."""

    within: bool
    depth: int

    def commas(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the commas outside of strings are, and how deep; the scan goes on behind the text."""
        quotes = data == QUOTE
        escapes = data == ESCAPE
        if escapes.any():
            place = np.arange(len(data))
            before = np.maximum.accumulate(np.where(escapes, -1, place))  # the last character that is no escape
            quotes[1:] &= (place[:-1] - before[:-1]) % 2 == 0
        outside = (np.cumsum(quotes) + self.within) % 2 == 0
        steps = np.isin(data, OPENING).astype(np.int64) - np.isin(data, CLOSING)
        steps[~outside] = 0
        depths = self.depth + np.cumsum(steps)
        found = np.flatnonzero(outside & (data == COMMA))
        if len(data):
            self.within, self.depth = not outside[-1], int(depths[-1])
        return found, depths[found]


def _texts(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[str]:
    """The parts' text, batch by batch: pieces with the commas between them, and before each but a file's first."""
    for batch in batches:
        if batch.num_rows:
            text = ",".join(batch.column(0).to_pylist())
            yield text if first else "," + text
            first = False


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


SUMMARY = "part int, within boolean, ends_within boolean, deeper long, depths array<long>, commas array<long>"


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, part) to a row for each way to start; the comma before the part is counted by the part."""
    scans = {w: Scan(w, 0) for w in (False, True)}
    counts: dict[bool, Counter[int]] = {False: Counter(), True: Counter()}
    part = None
    for batch in batches:
        if batch.num_rows:
            part = batch.column(1)[0].as_py()
            data = _bytes("," + ",".join(batch.column(0).to_pylist()))
            for w, scan in scans.items():
                depths, n = np.unique(scan.commas(data)[1], return_counts=True)
                counts[w].update(dict(zip(depths.tolist(), n.tolist(), strict=True)))
    if part is not None:
        rows = [(part, w, scan.within, scan.depth, list(counts[w]), list(counts[w].values())) for w, scan in scans.items()]
        types = (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SUMMARY.split(", ")])


@dataclass(frozen=True)
class Start:
    """How a part starts, and how many commas of depth 1 stand before it."""

    within: bool
    depth: int
    place: int


def starts(pieces: DataFrame) -> tuple[dict[int, Start], int]:
    """How each part of (value, part) starts, and the number of commas of depth 1 in all. A row for each part is collected."""
    rows = {(r.part, r.within): r for r in pieces.mapInArrow(summarise, SUMMARY).collect()}
    out, within, depth, place = {}, False, 0, 0
    for part in sorted({p for p, _ in rows}):
        r = rows[part, within]
        # the comma before a file's first piece isn't there; it is counted at depth 0, so it is none of depth 1
        out[part] = Start(within, depth, place)
        place += dict(zip(r.depths, r.commas, strict=True)).get(1 - depth, 0)
        within, depth = r.ends_within, depth + r.deeper
    if not out or within or depth != 0:
        raise PieceError("The file isn't one whole JSON array or object")
    return out, place


CUT = "pos long, part int, whole boolean, text string"


def cut(told: Broadcast, first_part: int, last_part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(value, part) to what lies between the commas of depth 1: (pos, part, whole, text); not whole: some other part has more of it."""

    def rows(out: list[tuple[int, int, bool, str]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.string())
        cols = zip(*out, strict=True) if out else [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (head := next(batches, None)) is None:
            return
        part = head.column(1)[0].as_py()
        begin, opened = told.value[part], part == first_part
        scan, place, held = Scan(begin.within, begin.depth), begin.place, []
        for text in _texts(chain([head], batches), opened):
            raw, at, out = text.encode("utf-8", "surrogatepass"), 0, []
            found, depths = scan.commas(np.frombuffer(raw, np.uint8))
            for k in found[depths == 1].tolist():
                held.append(raw[at:k].decode("utf-8", "surrogatepass"))
                out.append((place, part, opened, "".join(held)))
                held, opened, place, at = [], True, place + 1, k + 1
            held.append(raw[at:].decode("utf-8", "surrogatepass"))
            yield rows(out)
        yield rows([(place, part, opened and part == last_part, "".join(held))])

    return run


def fragments(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """(pos, text): what lies between the commas of depth 1 of a file's array or object, in order, without its brackets."""
    pieces = pinned(spark.read.option("lineSep", ",").text(path)).withColumn("part", F.spark_partition_id())
    start, last = starts(pieces)
    found = pieces.mapInArrow(cut(spark.sparkContext.broadcast(start), min(start), max(start)), CUT)
    if len(start) > 1:
        spanning = found.where("NOT whole").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("t"))
        joined = spanning.select("pos", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
        found = found.where("whole").select("pos", "text").unionByName(joined).orderBy("pos")
    closing = {"[": "]", "{": "}"}[opening]
    opened = F.when(F.col("pos") == 0, F.regexp_replace("text", rf"^{BOM}?\s*{re.escape(opening)}", "")).otherwise(F.col("text"))
    bare = F.when(F.col("pos") == last, F.regexp_replace(opened, rf"{re.escape(closing)}\s*$", "")).otherwise(opened)
    brackets = F.lit(True)
    for at, pattern in ((0, rf"^{BOM}?\s*{re.escape(opening)}"), (last, rf"{re.escape(closing)}\s*$")):
        brackets &= (F.col("pos") != at) | F.col("text").rlike(pattern)
    checked = F.when(brackets, bare).otherwise(F.raise_error(f"The file isn't one whole JSON value in {opening}{closing}").cast("string"))
    some = found.select("pos", checked.alias("text"))
    return some if last else some.where(F.col("text").rlike(r"\S"))  # nothing between the brackets: no element


def _element(texts: pa.Array) -> pa.Array:
    """The value as written, without space around it."""
    out = []
    for text in texts.to_pylist():
        value, end = jsontext.value_at(text, jsontext.SPACE.match(text).end())
        if text[end:].strip(" \t\r\n"):
            raise jsontext.Malformed(f"more than a value: {text[:80]}")
        out.append(jsontext.source(value))
    return pa.array(out, pa.string())


def _pair(text: str) -> tuple[str, str]:
    """The key, and the value as written; what stands behind the value isn't dropped but refused."""
    if not (key := jsontext.STRING.match(text, jsontext.SPACE.match(text).end())):
        raise jsontext.Malformed(f"no key: {text[:80]}")
    colon = jsontext.SPACE.match(text, key.end()).end()
    if text[colon : colon + 1] != ":":
        raise jsontext.Malformed(f"no colon: {text[:80]}")
    value, end = jsontext.value_at(text, jsontext.SPACE.match(text, colon + 1).end())
    if text[end:].strip(" \t\r\n"):
        raise jsontext.Malformed(f"more than a member: {text[:80]}")
    return jsontext.unescaped(key[1]), jsontext.source(value)


def _member(texts: pa.Array) -> pa.Array:
    found = [_pair(text) for text in texts.to_pylist()]
    keys, values = [x[0] for x in found], [x[1] for x in found]
    return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the elements of the file's array as written, primitives too, in order."""
    return fragments(spark, path, "[").select("pos", F.arrow_udf(_element, "string")("text").alias("value"))


def object_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, value): the members of the file's object as written; of a repeated key the last value, in the first one's place."""
    entries = fragments(spark, path, "{").select("pos", F.arrow_udf(_member, "struct<key:string,value:string>")("text").alias("e")).select("pos", "e.*")
    same = Window.partitionBy("key")
    placed = entries.withColumn("first", F.min("pos").over(same)).withColumn("last", F.max("pos").over(same))
    return placed.where("pos = last").select(F.col("first").alias("pos"), "key", "value").orderBy("pos")
