"""Strict reading of JSON bodies inside Arrow batches, shared by the schema-drift and the nested-record operator. Nothing here
depends on the depth of a body: what is too deep for the standard reader and writer is read and written with a stack."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator


def _no_constant(text: str):
    raise ValueError(f"{text} is no JSON value")


def _load(text: str):
    sys.set_int_max_str_digits(0)
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _load_deep(text)


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _load_deep(text: str):
    """One JSON value of any depth."""

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    def name_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        name, i = json.decoder.scanstring(text, i + 1, True)
        if text[(i := skip(i)) : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return name, skip(i + 1)

    open_: list[tuple[dict | list, str | None]] = []  # containers, each with its name in the one around it
    name, i = None, skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            j = skip(i + 1)
            if text[j : j + 1] != "}]"[c == "["]:
                open_.append(({} if c == "{" else [], name))
                name, i = name_at(j) if c == "{" else (None, j)
                continue
            value, i = {} if c == "{" else [], j + 1
        elif c == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
        elif word := next((w for w in _WORDS if text.startswith(w, i)), None):
            value, i = _WORDS[word], i + len(word)
        elif m := _NUMBER.match(text, i):
            value, i = float(m.group()) if m.group(2) or m.group(3) else int(m.group()), m.end()
        else:
            raise ValueError(f"no value at {i}")
        while True:  # the value is whole: it goes into its container, which may be whole then
            i = skip(i)
            if not open_:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return value
            box, outer = open_[-1]
            if isinstance(box, dict):
                box[name] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if isinstance(box, dict):
                    name, i = name_at(i)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end of a container at {i}")
            open_.pop()
            value, name, i = box, outer, i + 1


def dump(value) -> str:
    """JSON text of a value of any depth, with ", " and ": " between its parts."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out: list[str] = []

        def parts(v) -> Iterator:
            if not isinstance(v, (dict, list)) or not v:
                out.append(json.dumps(v, ensure_ascii=False))
                return
            for k, x in enumerate(v):
                out.append(", " if k else "{" if isinstance(v, dict) else "[")
                if isinstance(v, dict):
                    out.append(json.dumps(x, ensure_ascii=False) + ": ")
                yield parts(v[x] if isinstance(v, dict) else x)
            out.append("}" if isinstance(v, dict) else "]")

        descend(parts(value))
        return "".join(out)


def descend(walk: Iterator) -> None:
    """Runs a walk written as a generator that yields the walks below it, to any depth."""
    stack = [walk]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)


def parse_object(body: str | None) -> dict | None:
    """The object, or None unless the body is exactly one valid JSON object. Of a repeated key the last value counts."""
    if not body:
        return None
    try:
        value = _load(body)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def parse_container(text: str):
    """A list or an object written as JSON text, else None."""
    head = text.lstrip(" \t\r\n")[:1]
    if head not in ("[", "{"):
        return None
    try:
        return _load(text)
    except ValueError:
        return None


def kind_of(value) -> str:
    """JSON type; `integer` is a number written without fraction or exponent."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"
