"""A strict subset of TOML: sections, arrays of tables, double-quoted strings, numbers, booleans, one-line arrays.

Escapes in strings are kept as they stand.
"""

from __future__ import annotations

import re

STRING = r'"(?:\\.|[^"\\])*"'
COMMENT = re.compile(rf'((?:{STRING}|"(?:\\.|[^"\\])*$|[^"#])*)', re.S)
INTEGER = re.compile(r"[+-]?\d(?:_?\d)*")
FLOAT = re.compile(r"[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?|[+-]?(?:inf|nan|infinity)", re.I)
ITEM = re.compile(rf'((?:{STRING}|[^",])*)(?:,|\Z)', re.S)


class TomlError(ValueError):
    """Text that isn't in the subset; ``code`` names the reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def value_of(text: str):
    """A value, or TomlError."""
    if not text:
        raise TomlError("EmptyValue")
    if text[0] == '"':
        m = re.match(STRING, text, re.S)
        if m is None or text[-1] != '"':
            raise TomlError("UnterminatedString")
        if m.end() != len(text):
            raise TomlError("InvalidString")
        return text[1:-1]
    if text[0] == "'":
        raise TomlError("UnsupportedString")
    if text in ("true", "false"):
        return text == "true"
    if text[0] == "[":
        return array_of(text)
    if INTEGER.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if FLOAT.fullmatch(text):
        return float(text)
    raise TomlError("InvalidValue")


def array_of(text: str) -> list:
    if len(text) < 2 or text[-1] != "]":
        raise TomlError("UnterminatedArray")
    out, inner = [], text[1:-1].lstrip(" \t,")
    while inner:
        m = ITEM.match(inner)
        if m is None:
            raise TomlError("UnterminatedString")
        item = m[1].strip(" \t")
        if not item:
            raise TomlError("EmptyArrayItem")
        out.append(value_of(item))
        inner = inner[m.end() :].lstrip(" \t,")
    return out


def without_comment(line: str) -> str:
    return COMMENT.match(line)[1]


class Table:
    """A section's own values and its entries as an array of tables."""

    def __init__(self) -> None:
        self.values: dict[str, object] = {}
        self.entries: list[dict[str, object]] = []


def parse(text: str) -> dict[str, Table]:
    """Tables by name, in order; values before any section are in the table named by the empty string."""
    tables: dict[str, Table] = {}
    into: dict[str, object] | None = None
    for raw in text.split("\n"):
        line = without_comment(raw).strip(" \t\r")
        if not line:
            continue
        if len(line) >= 4 and line.startswith("[[") and line.endswith("]]"):
            into = {}
            tables.setdefault(line[2:-2].strip(" \t"), Table()).entries.append(into)
            continue
        if len(line) >= 2 and line[0] == "[" and line[-1] == "]":
            into = tables.setdefault(line[1:-1].strip(" \t"), Table()).values
            continue
        key, found, value = line.partition("=")
        key, value = key.strip(" \t"), value.strip(" \t")
        if not found:
            raise TomlError("MissingAssignment")
        if not key:
            raise TomlError("InvalidKey")
        if not value:
            raise TomlError("EmptyValue")
        parsed = value_of(value)
        if into is None:
            into = tables.setdefault("", Table()).values
        if key in into:
            raise TomlError("DuplicateKey")
        into[key] = parsed
    return tables
