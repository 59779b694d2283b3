"""JSON texts of any depth: the standard parser and writer, and iterative ones beyond the depth that these can take."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring
from typing import Any

_BLANKS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"n": ("null", None), "t": ("true", True), "f": ("false", False)}


def _reject(name: str):
    raise ValueError(name)


def decoded(text: str, whole: Callable[[str], Any] = int, broken: Callable[[str], Any] = float) -> Any:
    """The value of a JSON text; ValueError if it isn't valid. `whole` and `broken` make numbers without and with fraction or exponent."""
    try:
        return json.loads(text, parse_constant=_reject, parse_int=whole, parse_float=broken)
    except RecursionError:
        return _deep(text, whole, broken)


def _deep(text: str, whole: Callable[[str], Any], broken: Callable[[str], Any]) -> Any:
    def skip(at: int) -> int:
        return _BLANKS.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no key at {at}")
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return name, skip(at + 1)

    open_: list[list] = []  # containers that are not closed yet, each with the key that comes next
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "[") and c:
            value: Any = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = key(at)
                open_.append([value, name])
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in _WORDS and text.startswith(_WORDS[c][0], at):
            value, at = _WORDS[c][1], at + len(_WORDS[c][0])
        elif found := _NUMBER.match(text, at):
            value, at = (broken if found[2] or found[3] else whole)(found[0]), found.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:
            at = skip(at)
            if not open_:
                if at != len(text):
                    raise ValueError(f"text goes on at {at}")
                return value
            holder, name = open_[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[name] = value
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    open_[-1][1], at = key(at)
                break
            if c != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"no end at {at}")
            value, at = open_.pop()[0], at + 1


class _Text(str):
    """Text that is written as it is."""


def encoded(value: Any) -> str:
    """JSON text of a value, as the standard writer gives it, whatever its depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, left = [], [value]
        while left:
            x = left.pop()
            if isinstance(x, _Text):
                out.append(x)
            elif isinstance(x, (dict, list)) and x:
                pairs = [(_Text(json.dumps(k, ensure_ascii=False) + ": "), v) for k, v in x.items()] if isinstance(x, dict) else [(_Text(""), v) for v in x]
                parts = [_Text("{" if isinstance(x, dict) else "[")]
                for i, (name, v) in enumerate(pairs):
                    parts += [_Text(", ")] * (i > 0) + [name, v]
                left += reversed([*parts, _Text("}" if isinstance(x, dict) else "]")])
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)
