"""Package names that manifests give to root files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions.paths import file_name, parent
from codehealth.sources.toml import TomlError, parse

MANIFEST_BYTES = 64 * 1024
MANIFESTS = ("Cargo.toml", "package.json")
SKIPPED_PARTS = ("/target/", "/node_modules/", "/.git/", "/vendor/")


@dataclass(frozen=True)
class Alias:
    name: str
    root_file: str


def beside(manifest: str, path: str) -> str:
    above = parent(manifest)
    return f"{above}/{path}" if above else path


def cargo_aliases(manifest: str, text: str) -> list[Alias]:
    """The library's name, then the package's, for the library's root; none from a malformed manifest."""
    try:
        tables = parse(text)
    except TomlError:
        return []
    package = tables["package"].values.get("name") if "package" in tables else None
    if not isinstance(package, str):
        return []
    lib = tables["lib"].values if "lib" in tables else {}
    path = lib.get("path") if isinstance(lib.get("path"), str) else "src/lib.rs"
    names = [n for n in (lib.get("name"), package) if isinstance(n, str)]
    return [Alias(n.replace("-", "_"), beside(manifest, path)) for n in names]


def package_aliases(manifest: str, text: str) -> list[Alias]:
    """The package's name for its main file; a manifest with other keys than name and main gives none."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    if not isinstance(found, dict) or set(found) - {"name", "main"}:
        return []
    name, main = found.get("name"), found.get("main")
    if not isinstance(name, str) or not (main is None or isinstance(main, str)):
        return []
    return [Alias(name, beside(manifest, "index.js" if main is None else main))]


def named(manifests: Iterable[tuple[str, bytes]]) -> list[Alias]:
    """Aliases of manifests (path and content, in order); the first of a name counts."""
    out: dict[str, Alias] = {}
    for path, data in manifests:
        reader = READERS.get(file_name(path))
        if reader is None or any(p in path for p in SKIPPED_PARTS) or not 0 < len(data) <= MANIFEST_BYTES:
            continue
        for alias in reader(path, data.decode("utf-8", "surrogateescape")):
            out.setdefault(alias.name, alias)
    return list(out.values())


READERS = dict(zip(MANIFESTS, (cargo_aliases, package_aliases)))


def aliases(tree: DataFrame) -> dict[str, str]:
    """Root files by package name, of the manifests of ``tree`` (path, ord, name, content) whose root file is in it."""
    rows = tree.where(F.col("name").isin(*MANIFESTS) & F.col("content").isNotNull()).orderBy("ord").select("path", "content")
    found = named((r["path"], bytes(r["content"])) for r in rows.toLocalIterator())
    if not found:
        return {}
    roots = tree.sparkSession.createDataFrame([(a.name, a.root_file) for a in found], "name string, path string")
    return {r["name"]: r["path"] for r in roots.join(tree.select("path"), "path", "left_semi").collect()}
