"""The rule file: score floors, ceilings, layers and boundaries, checked before anything runs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from codehealth.sources import toml

# The keys of the constraints section.
FLOORS = ("min_quality", "min_modularity", "min_acyclicity", "min_depth", "min_equality", "min_redundancy")
CEILINGS = ("max_cycles", "max_file_lines", "max_fn_lines", "max_cyclomatic", "max_cognitive")
WHOLE_STRING = re.compile(toml.STRING, re.S)


class InvalidRules(ValueError):
    """A rule file that isn't well formed or whose values don't make sense."""


@dataclass(frozen=True)
class Layer:
    name: str
    paths: tuple[str, ...]
    order: int


@dataclass(frozen=True)
class Boundary:
    source: str
    target: str
    reason: str = ""


@dataclass(frozen=True)
class Rules:
    floors: dict[str, float] = field(default_factory=dict)
    ceilings: dict[str, int] = field(default_factory=dict)
    layers: tuple[Layer, ...] = ()
    boundaries: tuple[Boundary, ...] = ()


def require(condition: object) -> None:
    if not condition:
        raise InvalidRules("InvalidRules")


def balanced(value: str) -> bool:
    """Whether brackets outside strings close, and strings as well."""
    bare = re.sub(toml.STRING, "", value, flags=re.S)
    level = 0
    for c in bare:
        level += (c == "[") - (c == "]")
        if level < 0:
            return False
    return level == 0 and '"' not in bare


def check_syntax(text: str) -> None:
    """What a rule file must look like beyond what the parser takes: no repeated key or section, closed values."""
    section, listed, seen = "", False, set()
    for raw in text.split("\n"):
        line = toml.without_comment(raw).strip(" \t\r")
        if not line:
            continue
        if line[0] == "[":
            many = line.startswith("[[")
            require(len(line) >= 4 and line.endswith("]]") if many else len(line) >= 2 and line.endswith("]"))
            name = (line[2:-2] if many else line[1:-1]).strip(" \t")
            require(many or listed or not section or name != section)
            section, listed, seen = name, many, set()
            continue
        m = re.match(rf'((?:{toml.STRING}|[^"=])*)=', line, re.S)
        require(m)
        key, value = m[1].strip(" \t"), line[m.end() :].strip(" \t")
        require(key and value and value[0] != "'" and key not in seen)
        require(value[0] != '"' or WHOLE_STRING.fullmatch(value))
        require(value[0] != "[" or balanced(value))
        seen.add(key)


def is_text(value: object) -> bool:
    return isinstance(value, str) and value != ""


def is_count(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 32


def is_score(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value <= 1


def check_name(name: str) -> None:
    require(name not in ("", ".", "..") and not re.search(r"[\x00-\x20\x7f/\\*?\[\]]", name))


def check_pattern(pattern: str) -> None:
    """A glob of non-empty segments, relative, with at most one star in a segment other than **."""
    require(pattern and pattern[0] != "/" and not re.match(r"[A-Za-z]:", pattern))
    for segment in pattern.split("/"):
        require(segment not in ("", ".", ".."))
        bare = re.sub(r"\\.", "", segment, flags=re.S)
        require(not re.search(r"[\\\[\]\x00-\x1f\x7f]", bare) and (bare.count("*") <= 1 or segment == "**"))


def normal_pattern(pattern: str) -> str:
    """Backslashes as slashes, but for those that escape a mark right after a slash."""
    out = ""
    for k, c in enumerate(pattern):
        if c == "\\":
            escapes = out.endswith("/") and pattern[k + 1 : k + 2] in ("*", "?", "[", "]", "\\") and k + 1 < len(pattern)
            c = "\\" if escapes else "/"
        out += c
    check_pattern(out)
    return out


def parse_rules(text: str) -> Rules:
    """The rules of a file's text; InvalidRules or TomlError if it has none."""
    check_syntax(text)
    tables = toml.parse(text)
    for name, table in tables.items():
        require(name in ("constraints", "layers", "boundaries") or name == "" and not table.values)
        require(name == "constraints" or not table.values)
    constraints = tables["constraints"].values if "constraints" in tables else {}
    for key, value in constraints.items():
        require(is_score(value) if key in FLOORS else key in CEILINGS and is_count(value))
    layers, boundaries = [], []
    for entry in tables["layers"].entries if "layers" in tables else ():
        require(set(entry) == {"name", "paths", "order"} and is_text(entry["name"]) and is_count(entry["order"]))
        require(isinstance(entry["paths"], list) and entry["paths"] and all(map(is_text, entry["paths"])))
        check_name(entry["name"])
        layers.append(Layer(entry["name"], tuple(map(normal_pattern, entry["paths"])), entry["order"]))
    for entry in tables["boundaries"].entries if "boundaries" in tables else ():
        require({"from", "to"} <= set(entry) <= {"from", "to", "reason"} and is_text(entry["from"]) and is_text(entry["to"]))
        require(isinstance(entry.get("reason", ""), str))
        boundaries.append(Boundary(normal_pattern(entry["from"]), normal_pattern(entry["to"]), entry.get("reason", "")))
    found = Rules(
        {k: float(v) for k, v in constraints.items() if k in FLOORS}, {k: v for k, v in constraints.items() if k in CEILINGS}, tuple(layers), tuple(boundaries)
    )
    check_rules(found)
    return found


def check_rules(rules: Rules) -> None:
    """No layer name, layer pattern or boundary twice."""
    patterns = [p for layer in rules.layers for p in layer.paths]
    pairs = [(b.source, b.target) for b in rules.boundaries]
    names = [layer.name for layer in rules.layers]
    for name in names:
        check_name(name)
    for pattern in [*patterns, *(p for pair in pairs for p in pair)]:
        check_pattern(pattern)
    for values in (patterns, pairs, names):
        require(len(set(values)) == len(values))
