"""Batch runs: ``python -m sparkloom.cli --cli --input FILE --recipe FILE --output FILE``."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sparkloom.operators import execute
from sparkloom.plans import recipe as recipes
from sparkloom.plans.plan import fold
from sparkloom.sources import readers, writers
from sparkloom.types import DataFormat, PlanError

SUCCESS, FAILURE = 0, 1
FLAGS = ("--input", "--recipe", "--output")


class UsageError(ValueError):
    """Arguments that can't be understood."""


@dataclass(frozen=True)
class Arguments:
    input: str
    recipe: str
    output: str


def parse_arguments(args: list[str]) -> Arguments:
    if not args:
        raise UsageError("nothing to do; give --input, --recipe and --output")
    got: dict[str, str] = {}
    rest = iter(args)
    for flag in rest:
        if not flag.startswith("--"):
            raise UsageError(f"expected a flag in place of '{flag}'")
        if flag == "--cli":
            continue
        if flag not in FLAGS:
            raise UsageError(f"there is no flag {flag}")
        value = next(rest, "--")
        if value.startswith("--"):
            raise UsageError(f"{flag} needs a value")
        got[flag] = value
    for flag in FLAGS:
        if not got.get(flag, "").strip():
            raise UsageError(f"{flag} is needed")
    return Arguments(*(got[f] for f in FLAGS))


READERS = {DataFormat.Csv: readers.read_csv, DataFormat.JsonLines: readers.read_json_lines}


def run(spark: SparkSession, args: Arguments) -> None:
    recipe = recipes.load(args.recipe)
    source, sink = readers.detect_batch(args.input), readers.detect_batch(args.output)
    readers.detect(spark, args.input)
    records = READERS[source](spark, args.input)
    plan = fold(records.schema, recipe.actions)
    if sink is DataFormat.Csv:
        header, lines = execute.to_csv_lines(records, plan)
        writers.write_one(spark, lines, args.output, header)
    else:
        writers.write_one(spark, execute.to_json_lines(records, plan), args.output)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    try:
        wanted = parse_arguments(args)
        run(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), wanted)
    except recipes.RecipeError as e:
        print(f"the recipe can't be read: {e}", file=sys.stderr)
    except PlanError as e:
        print(f"the recipe doesn't fit the table: {e}", file=sys.stderr)
    except Exception as e:  # noqa: BLE001  a run ends with 0 or 1
        print(f"failed: {e}", file=sys.stderr)
    else:
        return SUCCESS
    return FAILURE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
