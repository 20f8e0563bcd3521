"""Globs as regular expressions that Python, Spark and DuckDB read alike."""

from __future__ import annotations

import re


def segment_regex(segment: str) -> str:
    """``*`` is any run inside a segment, ``?`` one character, a backslash takes the next character as it is."""
    out = ""
    for m in re.finditer(r"\\(.)|(.)", segment, re.S):
        if m[1] is not None:
            out += re.escape(m[1])
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(m[2], re.escape(m[2]))
    return out


def segments_regex(segments: list[str]) -> str:
    """Segments one after the other; ``**`` is any number of them, also none."""
    out = ""
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment != "**":
            out += segment_regex(segment) + ("" if last else "/")
        elif not last:
            out += "(?:[^/]*/)*"
        else:
            out = f"{out[:-1]}(?:/.*)?" if out.endswith("/") else f"{out}.*"
    return out


def glob_regex(pattern: str) -> str:
    """An anchored pattern for the paths that a glob matches.

    Besides itself segment by segment a glob means: the same with backslashes as
    separators; without a slash, the last component alone; without wildcards, all paths
    below it.
    """
    ways = [re.escape(pattern), segments_regex(pattern.split("/"))]
    if "\\" in pattern:
        ways.append(segments_regex(re.split(r"[/\\]", pattern)))
    if "/" not in pattern:
        ways.append(f"(?:.*/)?{segment_regex(pattern)}")
    elif "*" not in pattern and "?" not in pattern:
        ways.append(f"{re.escape(pattern)}/.*")
    return "(?s)^(?:" + "|".join(dict.fromkeys(ways)) + ")$"


def glob_match(pattern: str, path: str) -> bool:
    return re.match(glob_regex(pattern)[:-1] + r"\Z", path) is not None
