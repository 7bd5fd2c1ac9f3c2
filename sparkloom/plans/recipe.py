"""Recipes: a name and a stack of actions, kept as a small and strict part of YAML, or as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import astuple, dataclass
from datetime import datetime
from enum import Enum
from pathlib import Path

from sparkloom.functions.predicates import Operator
from sparkloom.plans.actions import KINDS, NAMES, Action


class RecipeError(ValueError):
    """A recipe that can't be read."""


@dataclass(frozen=True)
class Recipe:
    name: str
    actions: tuple[Action, ...] = ()
    description: str | None = None
    last_modified: str | None = None

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise RecipeError("a recipe needs a name")


ITEM, ROOT_KEYS = "  - type: ", ("name", "description", "lastModified")


def _pair(text: str, complaint: str) -> tuple[str, str]:
    key, found, value = text.partition(": ")
    if not found:
        raise RecipeError(complaint)
    return key, value


def unquote(value: str) -> str:
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.S)
    return value


def quote(value: str) -> str:
    return '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def read_enum(kind: type[Enum], text: str) -> Enum:
    """Operators in any case, types as written; either by number too."""
    names = {(m.name.lower() if kind is Operator else m.name): m for m in kind}
    text = text.strip()
    if m := names.get(text.lower() if kind is Operator else text):
        return m
    if re.match(r"^[0-9]+$", text) and int(text) < len(kind):
        return list(kind)[int(text)]
    raise ValueError(text)


def build_action(fields: dict[str, str]) -> Action:
    kind = fields.get("type", "")
    if kind not in KINDS:
        raise RecipeError(f"there is no action '{kind}'")
    cls, wanted = KINDS[kind]
    values = []
    for name, read in wanted.items():
        if name not in fields:
            raise RecipeError(f"a {kind} action needs {name}")
    for name, read in wanted.items():
        text = fields[name]
        if read is str:
            if name == "targetFormat" and not text.strip():
                raise RecipeError(f"{name} of a {kind} action is blank")
            values.append(text)
            continue
        try:
            values.append(read_enum(read, text))
        except ValueError as e:
            raise RecipeError(f"'{text}' is no {name}") from e
    return cls(*values)


def _timestamp(value: str) -> str:
    text = re.sub(r"(\.\d{6})\d+", r"\1", unquote(value)).replace("Z", "+00:00")
    try:
        datetime.fromisoformat(text)
    except ValueError as e:
        raise RecipeError(f"lastModified is no time: '{value}'") from e
    return unquote(value)


def parse(text: str) -> Recipe:
    """Root keys, then `actions:` with items of fields; blank lines and comments are skipped, all else is an error."""
    root: dict[str, str] = {}
    items: list[dict[str, str]] | None = None
    for line in (x.rstrip("\r") for x in text.split("\n")):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if items is None:
            if line == "actions:":
                items = []
            elif line != "actions: []":
                key, value = _pair(line, f"a line that is no key and value: '{line}'")
                if key not in ROOT_KEYS:
                    raise RecipeError(f"a recipe has no key '{key}'")
                if root.get(key) if key == "name" else key in root:
                    raise RecipeError(f"the key '{key}' stands twice")
                root[key] = _timestamp(value) if key == "lastModified" else unquote(value)
        elif line.startswith(ITEM):
            items.append({"type": line.removeprefix(ITEM)})
        elif items and line.startswith("    "):
            key, value = _pair(line[4:], f"Malformed action field: '{line}'")
            items[-1][key] = unquote(value)
        else:
            raise RecipeError(f"a line that belongs to no action: '{line}'")
    actions = tuple(map(build_action, items or []))
    if not root.get("name"):
        raise RecipeError("a recipe needs a name")
    return Recipe(root["name"], actions, root.get("description"), root.get("lastModified"))


def _fields(action: Action) -> list[tuple[str, str | Enum]]:
    return list(zip(KINDS[NAMES[type(action)]][1], astuple(action), strict=True))


def serialize(recipe: Recipe) -> str:
    head = {"name": recipe.name, "description": recipe.description, "lastModified": recipe.last_modified}
    lines = [f"{k}: {quote(v)}" for k, v in head.items() if v is not None]
    lines.append("actions:" if recipe.actions else "actions: []")
    for action in recipe.actions:
        lines.append(ITEM + NAMES[type(action)])
        lines += [f"    {k}: {v.name if isinstance(v, Enum) else quote(v)}" for k, v in _fields(action)]
    return "\n".join(lines) + "\n"


def to_json(recipe: Recipe) -> str:
    actions = [{"type": NAMES[type(a)]} | {k: v.name if isinstance(v, Enum) else v for k, v in _fields(a)} for a in recipe.actions]
    head = {"name": recipe.name, "description": recipe.description, "lastModified": recipe.last_modified}
    return json.dumps({k: v for k, v in head.items() if v is not None} | {"actions": actions}, ensure_ascii=False)


def from_json(text: str) -> Recipe:
    got = json.loads(text)
    return Recipe(got["name"], tuple(map(build_action, got.get("actions", []))), got.get("description"), got.get("lastModified"))


def load(path: str) -> Recipe:
    if not Path(path).exists():
        raise RecipeError(f"no recipe at {path}")
    return parse(Path(path).read_text("utf-8-sig"))


def save(recipe: Recipe, path: str) -> None:
    Path(path).write_text(serialize(recipe), "utf-8", newline="\n")


