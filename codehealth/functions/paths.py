"""Path algebra: plain functions for driver code and stages, Columns for plans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory and file names that carry meaning.
DOMINANT_DIRS = ("src", "lib", "app", "pkg", "cmd", "bin", "internal")
ENTRY_FILES = ("main.go", "main.rs", "main.zig", "main.py", "main.c", "main.cpp", "index.js", "index.ts", "__main__.py", "build.zig")
INDEX_FILES = ("mod.rs", "__init__.py", "index.js", "index.ts", "lib.rs", "mod.zig")

#: A path component that marks test code.
TEST_COMPONENT = r"(?:tests?|__tests__|[^./\\]*\.(?:[^/\\]*\.)?(?:test|spec)(?:\.[^/\\]*)?|(?:tests?|__tests__|spec|test[_-][^./\\]*|[^./\\]*_(?:tests?|spec))(?:\.[^/\\]*)?)"
TEST_PATH = rf"(?s)^(?:.*[/\\])?{TEST_COMPONENT}(?:[/\\].*)?$"
_TEST = re.compile(TEST_PATH)


class InvalidPath(ValueError):
    """A path that is absolute, leaves its root, or has a NUL."""


def is_absolute(path: str) -> bool:
    return re.match(r"[/\\]|[A-Za-z]:", path) is not None


def canonical(path: str) -> str:
    """``path`` with / between its components and no . or .. among them."""
    if is_absolute(path) or "\0" in path:
        raise InvalidPath(path)
    out: list[str] = []
    for part in re.split(r"[/\\]", path):
        if part == "..":
            if not out:
                raise InvalidPath(path)
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def file_name(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def parent(path: str) -> str | None:
    """The directory part, None for a path without a separator."""
    m = re.match(r"(?s)(.*)[/\\]", path)
    return m[1] if m else None


def strip_extension(path: str) -> str:
    return re.sub(r"\.[^./\\]*\Z", "", path)


def extension(path: str) -> str:
    m = re.search(r"\.([^./\\]*)\Z", path)
    return m[1] if m else ""


def module_of(path: str) -> str:
    """The module of a file: its directory to a depth of three, or itself at the root and right below a dominant directory."""
    parts = re.split(r"[/\\]", path)
    if len(parts) == 1 or len(parts) == 2 and parts[0] in DOMINANT_DIRS:
        return strip_extension(path)
    ends = [m.start() for m in re.finditer(r"[/\\]", path)]
    return path[: ends[min(3, len(ends)) - 1]]


def is_entry(path: str) -> bool:
    """Whether the file is a conventional program entry."""
    name, above = file_name(path), parent(path)
    if name in ENTRY_FILES:
        return True
    return above is not None and (name == "app.py" or name.endswith((".rs", ".zig")) and above.endswith(("src/bin", "src\\bin")))


def is_index(path: str) -> bool:
    return file_name(path) in INDEX_FILES


def is_test(path: str) -> bool:
    return _TEST.match(path) is not None


# Columns. They hold for the same inputs as the functions above.


def name_col(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def parent_col(path: Column) -> Column:
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1))


def strip_extension_col(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$(?![\r\n])", "")


def extension_col(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def depth_col(path: Column) -> Column:
    return F.size(F.split(path, r"[/\\]")) - 1


def module_col(path: Column) -> Column:
    parts = F.split(path, r"[/\\]")
    n = F.size(parts)
    lone = (n == 1) | ((n == 2) & F.element_at(parts, 1).isin(*DOMINANT_DIRS))
    return F.when(lone, strip_extension_col(path)).otherwise(F.regexp_extract(path, r"^((?:[^/\\]*[/\\]){0,2}[^/\\]*)[/\\]", 1))


def is_entry_col(path: Column) -> Column:
    name, above = name_col(path), parent_col(path)
    rust_bin = name.rlike(r"\.(rs|zig)$") & above.rlike(r"src[/\\]bin$")
    return name.isin(*ENTRY_FILES) | F.coalesce((name == "app.py") & above.isNotNull() | rust_bin, F.lit(False))


def is_index_col(path: Column) -> Column:
    return name_col(path).isin(*INDEX_FILES)


def is_test_col(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def walk_order(path: Column) -> Column:
    """Sorts paths as a depth-first walk meets them: names in byte order inside each directory."""
    return F.split(path, "/")
