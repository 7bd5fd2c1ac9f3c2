"""A stack of actions folded into one projection under one conjunction of filters.

Batch and view mode differ. Batch: a cast tags a column for later filters and formats, fill and format share one place in
which the last one stands, and formats need timestamps. View: a cast renders the column, fill gives it the type of its
constant and hides any format, and formats show on timestamps only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum
from functools import singledispatch

from sparkloom.functions.inference import infer_text
from sparkloom.functions.predicates import Operator
from sparkloom.plans import actions as A
from sparkloom.types import LogicalType, PlanError, TableSchema


class Mode(Enum):
    Batch = "batch"
    View = "view"


@dataclass(frozen=True)
class Output:
    """A column of the result: where it comes from, its current name (None: hidden), its type, and what stands in its cells."""

    source: str
    name: str | None
    type: LogicalType
    fill: str | None = None
    format: str | None = None


@dataclass(frozen=True)
class RowFilter:
    """Compares the source's own cells, whatever later becomes of the column."""

    source: str
    type: LogicalType
    operator: Operator
    value: str


@dataclass(frozen=True)
class Plan:
    outputs: tuple[Output, ...]
    filters: tuple[RowFilter, ...] = ()
    mode: Mode = Mode.Batch
    typed: bool = False

    @property
    def visible(self) -> tuple[Output, ...]:
        return tuple(o for o in self.outputs if o.name is not None)

    def sources(self) -> list[str]:
        """The source columns whose cells are needed."""
        needed = [o.source for o in self.visible if o.fill is None] + [f.source for f in self.filters]
        return list(dict.fromkeys(needed))

    def headers(self) -> list[str]:
        return [f"{o.name} ({o.type.value})" for o in self.visible]

    def changed(self, at: Output, **changes: object) -> Plan:
        return replace(self, outputs=tuple(replace(o, **changes) if o is at else o for o in self.outputs))


@singledispatch
def step(action: object, plan: Plan, at: Output) -> Plan:
    raise PlanError(f"Unknown action: {action}")


@step.register
def _(action: A.Rename, plan: Plan, at: Output) -> Plan:
    hidden = replace(plan, outputs=tuple(replace(o, name=None) if o.name == action.new_name and o is not at else o for o in plan.outputs))
    return hidden.changed(at, name=action.new_name)


@step.register
def _(action: A.Delete, plan: Plan, at: Output) -> Plan:
    return plan.changed(at, name=None)


@step.register
def _(action: A.Cast, plan: Plan, at: Output) -> Plan:
    return plan.changed(at, type=action.target)


@step.register
def _(action: A.Filter, plan: Plan, at: Output) -> Plan:
    return replace(plan, filters=(*plan.filters, RowFilter(at.source, at.type, action.operator, action.value)))


@step.register
def _(action: A.Fill, plan: Plan, at: Output) -> Plan:
    if plan.mode is Mode.View:
        return plan.changed(at, fill=action.value, type=infer_text(action.value))
    return plan.changed(at, fill=action.value, format=None)


@step.register
def _(action: A.FormatTimestamp, plan: Plan, at: Output) -> Plan:
    if plan.mode is Mode.View:
        return plan.changed(at, format=action.format)
    if at.type is not LogicalType.Timestamp:
        raise PlanError(f"Column '{action.column}' is not a Timestamp column")
    return plan.changed(at, format=action.format, fill=None)


def target(action: A.Action) -> str:
    return action.old_name if isinstance(action, A.Rename) else action.column


def fold(schema: TableSchema, stack: tuple[A.Action, ...], mode: Mode = Mode.Batch) -> Plan:
    """Actions apply in order and find columns by their current names; an action on an unknown name does nothing."""
    plan = Plan(tuple(Output(c.name, c.name, c.type) for c in schema.columns), mode=mode, typed=bool(stack))
    for action in stack:
        if at := next((o for o in plan.outputs if o.name == target(action)), None):
            plan = step(action, plan, at)
    return plan
