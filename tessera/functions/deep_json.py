"""JSON of any nesting depth, read and written with explicit stacks where the usual functions run out of theirs."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMED = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_NAME = re.compile(r"true|false|null|NaN|-?Infinity")


def loads(text: str):
    """The value of a JSON text; ValueError if it is damaged."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads(text)


def dumps(v) -> str:
    """The JSON text of a value, without spaces."""
    try:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return _dumps(v)


def _loads(text: str):
    top: list = []
    # open containers, innermost last; of an object also the name that waits for its value
    stack: list[tuple] = []
    names: list = []
    i, n = _SPACE.match(text, 0).end(), len(text)
    value_due = True
    while True:
        if value_due:
            if i >= n:
                raise ValueError("a value is missing")
            c = text[i]
            if c in "[{":
                new: list | dict = [] if c == "[" else {}
                _put(top, stack, names, new)
                stack.append(new)
                names.append(None)
                i = _SPACE.match(text, i + 1).end()
                if text[i : i + 1] == ("]" if c == "[" else "}"):
                    value_due = False
                elif c == "{":
                    i = _name(text, i, names)
                continue
            if c == '"':
                v, i = scanstring(text, i + 1, True)
            elif m := _NAME.match(text, i):
                v, i = _NAMED[m[0]], m.end()
            elif m := _NUMBER.match(text, i):
                v, i = (float if m[1] or m[2] else int)(m[0]), m.end()
            else:
                raise ValueError(f"no value at {i}")
            _put(top, stack, names, v)
            i = _SPACE.match(text, i).end()
            value_due = False
        if not stack:
            if i < n:
                raise ValueError(f"something follows at {i}")
            return top[0]
        c = text[i : i + 1]
        i = _SPACE.match(text, i + 1).end()
        if c == ",":
            if isinstance(stack[-1], dict):
                i = _name(text, i, names)
            value_due = True
        elif c == ("]" if isinstance(stack[-1], list) else "}"):
            stack.pop()
            names.pop()
        else:
            raise ValueError(f"no end of a value at {i}")


def _put(top: list, stack: list, names: list, v) -> None:
    if not stack:
        top.append(v)
    elif isinstance(stack[-1], list):
        stack[-1].append(v)
    else:
        stack[-1][names[-1]] = v


def _name(text: str, i: int, names: list) -> int:
    if text[i : i + 1] != '"':
        raise ValueError(f"no name at {i}")
    names[-1], i = scanstring(text, i + 1, True)
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return _SPACE.match(text, i + 1).end()


def _dumps(v) -> str:
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, v)]  # (is it text as it stands, the text or value)
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            out.append("{")
            todo.append((True, "}"))
            for k, (name, y) in reversed(list(enumerate(x.items()))):
                todo += [(False, y), (True, ("," if k else "") + json.dumps(name, ensure_ascii=False) + ":")]
        elif isinstance(x, list):
            out.append("[")
            todo.append((True, "]"))
            for k, y in reversed(list(enumerate(x))):
                todo.append((False, y))
                if k:
                    todo.append((True, ","))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
