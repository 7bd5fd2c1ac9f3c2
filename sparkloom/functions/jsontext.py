"""JSON read as text: values keep their own spelling, and what stands before an error can still be read."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from sparkloom.functions.inference import infer_token
from sparkloom.functions.scalars import double_text_py, group_digits

SPACE = re.compile(r"[ \t\n\r]*")
STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
PLAIN = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?=[ \t\n\r,\]}]|$)|(true|false)|(null)")
MISSING, MALFORMED = "missing", "invalid"
NULL_TEXT, ERROR_TEXT = "<null>", "<error>"


class Malformed(ValueError):
    """Text that isn't JSON from here on."""


class Value(NamedTuple):
    """A value's kind (string, number, bool, null, object, array) and its text as written; of strings without the quotes."""

    kind: str
    raw: str


def _no_constant(name: str) -> None:
    raise ValueError(name)


#: Objects come as tuples of their pairs, so repeated keys are kept.
_decoder = json.JSONDecoder(object_pairs_hook=tuple, parse_constant=_no_constant)


def _skip(s: str, i: int) -> int:
    return SPACE.match(s, i).end()


def value_at(s: str, i: int) -> tuple[Value, int]:
    """The value that starts at i, and where it ends."""
    first = s[i : i + 1]
    if first == '"':
        if not (m := STRING.match(s, i)):
            raise Malformed(f"string at {i}")
        return Value("string", m[1]), m.end()
    if first and first in "{[":
        try:
            end = _decoder.raw_decode(s, i)[1]
        except (ValueError, RecursionError) as e:
            raise Malformed(str(e)) from e
        return Value("object" if first == "{" else "array", s[i:end]), end
    if not (m := PLAIN.match(s, i)):
        raise Malformed(f"value at {i}")
    return Value("number" if m[1] else "bool" if m[2] else "null", m[0]), m.end()


def members(s: str, i: int = 0) -> Iterator[tuple[str, Value]]:
    """Keys and values of the object that starts at i, in order; Malformed is raised where the text stops being JSON."""
    i = _skip(s, i)
    if s[i : i + 1] != "{":
        raise Malformed("not an object")
    i = _skip(s, i + 1)
    if s[i : i + 1] == "}":
        return
    while True:
        if not (m := STRING.match(s, i)):
            raise Malformed(f"key at {i}")
        i = _skip(s, m.end())
        if s[i : i + 1] != ":":
            raise Malformed(f"no colon at {i}")
        value, i = value_at(s, _skip(s, i + 1))
        yield unescaped(m[1]), value
        i = _skip(s, i)
        if s[i : i + 1] == "}":
            return
        if s[i : i + 1] != ",":
            raise Malformed(f"no comma at {i}")
        i = _skip(s, i + 1)


def elements(s: str, i: int = 0) -> Iterator[Value]:
    """The values of the array that starts at i, in order."""
    i = _skip(s, i)
    if s[i : i + 1] != "[":
        raise Malformed("not an array")
    i = _skip(s, i + 1)
    if s[i : i + 1] == "]":
        return
    while True:
        value, i = value_at(s, i)
        yield value
        i = _skip(s, i)
        if s[i : i + 1] == "]":
            return
        if s[i : i + 1] != ",":
            raise Malformed(f"no comma at {i}")
        i = _skip(s, i + 1)


def source(value: Value) -> str:
    """The value as it stands in JSON."""
    return f'"{value.raw}"' if value.kind == "string" else value.raw


def unescaped(raw: str) -> str:
    if "\\" not in raw:
        return raw
    text = json.loads(f'"{raw}"')
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def count(value: Value) -> int:
    """Members of an object, repeated keys included, or elements of an array."""
    return len(_decoder.decode(value.raw))


def display(value: Value) -> str:
    """A cell as a table shows it, which is also what filters see."""
    if value.kind == "number":
        if len(value.raw) < 19 and value.raw.isdigit() and (value.raw[0] != "0" or value.raw == "0"):
            return value.raw
        if re.match(r"^-?[0-9]+$", value.raw) and -(1 << 63) <= int(value.raw) < 1 << 63:
            return str(int(value.raw))
        return double_text_py(float(value.raw))
    if value.kind == "bool":
        return value.raw.title()
    if value.kind == "object":
        return f"{{Object: {group_digits(count(value))} properties}}"
    if value.kind == "array":
        return f"[Array: {group_digits(count(value))} items]"
    return NULL_TEXT if value.kind == "null" else value.raw


class _Number(str):
    """A number as written."""

    __slots__ = ()


_flat = json.JSONDecoder(object_pairs_hook=list, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)


def _flat_pairs(line: str) -> list[tuple[str, object]] | None:
    """Keys and values of a line without nested values or escapes, which a plain decoder can read; None for any other line."""
    if "\\" in line or "[" in line or line.count("{") != 1:
        return None
    try:
        pairs = _flat.decode(line)
    except ValueError:
        return None
    return pairs if type(pairs) is list else None


def _flat_members(line: str) -> list[tuple[str, Value]] | None:
    """members() of such a line."""
    if (pairs := _flat_pairs(line)) is None:
        return None
    out = []
    for key, v in pairs:
        kind = "number" if type(v) is _Number else "string" if type(v) is str else "null" if v is None else "bool"
        out.append((key, Value(kind, "null" if v is None else str(v) if kind != "bool" else "true" if v else "false")))
    return out


Cell = tuple[str, str | None, str | None]
LACKING: Cell = (MISSING, None, NULL_TEXT)


def _plain_cell(v: object, shown: bool) -> Cell:
    """The cell of a value that a plain decoder has read."""
    if type(v) is str:
        return ("string", v, v)
    if type(v) is _Number:
        return ("number", str(v), display(Value("number", str(v))) if shown else None)
    if v is None:
        return ("null", None, NULL_TEXT)
    text = "true" if v else "false"
    return ("bool", text, text.title())


def find(line: str, keys: list[str], shown: bool = True) -> list[Cell]:
    """For each key its first value in the line's object: (kind, text, display). The kind is missing or invalid where there is none; without shown a display may be lacking."""
    if (pairs := _flat_pairs(line)) is not None:
        first = dict(reversed(pairs))
        return [_plain_cell(first[k], shown) if k in first else LACKING for k in keys]
    wanted, found, broken = set(keys), {}, False
    try:
        for key, value in members(line):
            if key in wanted and key not in found:
                found[key] = value
                if len(found) == len(wanted):
                    break
    except Malformed:
        broken = True
    lack = (MALFORMED, None, ERROR_TEXT) if broken else LACKING
    cell = {k: (v.kind, None if v.kind == "null" else unescaped(v.raw) if v.kind == "string" else v.raw, display(v) if shown else None) for k, v in found.items()}
    return [cell.get(k, lack) for k in keys]


def types(line: str) -> list[tuple[str, str | None]]:
    """Keys of the line's object and the names of their values' types (null: none); a malformed line has what precedes the error."""
    out: dict[str, str | None] = {}
    try:
        for key, value in _flat_members(line) or members(line):
            if key not in out:
                out[key] = t.name if (t := infer_token(value.kind, value.raw)) else None
    except Malformed:
        pass
    return list(out.items())
