"""Recipes over streams. A plan has no state, so it needs no watermark and runs in any output mode that appends."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.operators import execute
from sparkloom.plans.plan import Mode, fold
from sparkloom.plans.recipe import Recipe
from sparkloom.sources.records import JsonRecords, typed_records
from sparkloom.types import TableSchema


def replay(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """A recipe over a stream (or a frame) of typed or text columns."""
    records = typed_records(stream)
    return execute.to_frame(records, fold(records.schema, recipe.actions, Mode.Batch))


def replay_json_lines(stream: DataFrame, schema: TableSchema, recipe: Recipe) -> DataFrame:
    """A recipe over a stream of JSON lines, in column value, of a given schema; the result is JSON lines."""
    return execute.to_json_lines(JsonRecords(stream, schema), fold(schema, recipe.actions, Mode.Batch))
