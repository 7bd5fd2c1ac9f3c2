"""A plan carried out over records: one filter under one projection, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.functions.predicates import predicate
from sparkloom.functions.timestamps import format_timestamp, parse_timestamp, spark_pattern
from sparkloom.plans.plan import Mode, Output, Plan
from sparkloom.sources.records import Records, TextRecords


def filtered(records: Records, plan: Plan) -> Records:
    ready = records.prepared(plan.sources(), plan.mode, plan.mode is Mode.View or bool(plan.filters))
    tests = [predicate(cell, f.type, f.operator, f.value, kind) for f in plan.filters for cell, kind in [ready.filter_cell(f, plan.mode)]]
    if not tests:
        return ready
    frame = ready.frame.where(reduce(lambda a, b: a & b, tests))
    return type(ready)(**{**ready.__dict__, "frame": frame})


def formatted(c: Column, format: str) -> Column:
    """Fails on a cell that isn't a timestamp."""
    ts = parse_timestamp(c)
    complaint = F.concat(F.lit("Could not parse timestamp value '"), F.coalesce(c, F.lit("")), F.lit("'."))
    return F.when(ts.isNull(), F.raise_error(complaint).cast("string")).otherwise(format_timestamp(ts, format))


def batch_cell(records: Records, o: Output) -> Column:
    if o.fill is not None:
        return F.lit(o.fill)
    if o.format is not None:
        spark_pattern(o.format)
        return formatted(records.text(o.source), o.format)
    if isinstance(records, TextRecords):
        return records.raw(o.source)
    return records.text(o.source)


def view_cell(records: Records, o: Output, typed: bool) -> Column:
    if o.fill is not None:
        return F.lit(o.fill)
    shown = records.shown(o.source)
    return scalars.render(shown, o.type, o.format) if typed else shown


def to_frame(records: Records, plan: Plan) -> DataFrame:
    """The result as columns: cells as they are in batch mode, rendered by type in view mode once there is any action."""
    ready = filtered(records, plan)
    cell = (lambda o: view_cell(ready, o, plan.typed)) if plan.mode is Mode.View else (lambda o: batch_cell(ready, o))
    return ready.frame.select(*[cell(o).alias(o.name) for o in plan.visible])


def to_json_lines(records: Records, plan: Plan) -> DataFrame:
    """The result as JSON lines, in column value: missing cells are left out, raw JSON stays as written."""
    ready = filtered(records, plan)

    def fragment(o: Output) -> Column:
        value = ready.json(o.source) if o.fill is None and o.format is None else scalars.json_scalar(batch_cell(ready, o))
        return F.concat(scalars.json_string(F.lit(o.name)), F.lit(":"), value)

    return ready.frame.select(F.concat(F.lit("{"), F.concat_ws(",", *map(fragment, plan.visible)), F.lit("}")).alias("value"))


def csv_field(c: Column) -> Column:
    """Nothing for null, quotes for an empty text and around what needs them."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when((c == "") | c.rlike(r'[",\r\n]'), quoted).otherwise(c)


def to_csv_lines(records: Records, plan: Plan) -> tuple[str, DataFrame]:
    """The header, and the result as CSV lines in column value."""
    ready = filtered(records, plan)
    fields = [csv_field(batch_cell(ready, o).cast("string")) for o in plan.visible]
    quote = lambda n: '"' + n.replace('"', '""') + '"' if any(x in n for x in '",\r\n') else n
    return ",".join(quote(o.name) for o in plan.visible), ready.frame.select(F.concat_ws(",", *fields).alias("value") if fields else F.lit("").alias("value"))
