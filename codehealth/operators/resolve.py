"""Resolving import texts to files.

An import becomes a ranked list of probes: exact paths, and suffixes of extensionless
paths, which count only if one file has them. The lowest-ranked probe that an index holds
is the target. Both indexes are tables, so resolution is one equi-join and a ``min_by``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.functions import paths as P
from codehealth.sources.languages import EXTENSIONS, SOURCE_EXTENSIONS

# Module names that belong to each language's own library.
STDLIB = {
    "zig": "std builtin",
    "rust": "std core alloc proc_macro",
    "python": """abc argparse asyncio base64 collections contextlib copy csv dataclasses datetime enum functools glob hashlib http inspect io
        itertools json logging math os pathlib random re shutil signal socket sqlite3 string struct subprocess sys tempfile textwrap threading
        time traceback typing unittest urllib uuid warnings""",
    "javascript": """assert buffer child_process cluster console crypto dgram dns events fs http http2 https module net os path perf_hooks
        process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib""",
    "go": """bufio bytes context crypto embed encoding errors flag fmt hash html image index io log math mime net os path plugin reflect
        regexp runtime sort strconv strings sync syscall testing text time unicode unsafe""",
}
STDLIB = {lang: frozenset(names.split()) for lang, names in STDLIB.items()}
STDLIB["typescript"] = STDLIB["javascript"]

PATH, SUFFIX = "path", "suffix"


def suffixes(path: str) -> list[str]:
    """The path and what is left of it without its first, first two, ... components."""
    parts = path.split("/")
    return ["/".join(parts[k:]) for k in range(len(parts))]


def by_path(path: str) -> Iterator[tuple[str, str]]:
    """The path itself, then with each source extension."""
    yield PATH, path
    for ext in SOURCE_EXTENSIONS:
        yield PATH, path + ext


def by_suffix(path: str) -> Iterator[tuple[str, str]]:
    for k, s in enumerate(suffixes(path)):
        if k and not s:
            return
        yield SUFFIX, s


def anywhere(path: str) -> Iterator[tuple[str, str]]:
    yield from by_path(path)
    yield from by_suffix(path)


def relative(text: str, folder: str) -> Iterator[tuple[str, str]]:
    """A location seen from ``folder``, also as a package directory."""
    parts = folder.split("/") if folder else []
    for part in text.split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts = [*parts, part]
    joined = "/".join(parts)
    yield from anywhere(joined)
    yield SUFFIX, P.strip_extension(joined)


def slashed(raw: str) -> str:
    """Module separators as slashes, without a leading crate; empty for a bare self, super or crate."""
    text = raw.removeprefix("crate::").removeprefix("crate/")
    if text in ("self", "super", "crate"):
        return ""
    return re.sub("//+", "/", re.sub(r"[:\\]", "/", text)) if re.search(r"[:\\]", text) else text


def is_stdlib(raw: str, path: str) -> bool:
    """Whether a bare name belongs to the library of the importing file's language."""
    name = P.file_name(raw.rstrip(" \t\r;"))
    if any(len(name) > len(e) and name.endswith(e) for e in SOURCE_EXTENSIONS):
        return False
    lang = EXTENSIONS.get(P.extension(path), "")
    return re.split(r"[/:.]", raw, maxsplit=1)[0] in STDLIB.get(lang, ())


def aliased(path: str, aliases: dict[str, str]) -> str | None:
    """The path with its longest prefix that names a package replaced by the directory of the package's root file."""
    end = len(path)
    while end > 0:
        if (root := aliases.get(path[:end])) is not None:
            if end == len(path):
                return root
            above = P.parent(root)
            return None if above is None else f"{above}/{path[end + 1 :]}"
        end = path.rfind("/", 0, end)
    return None


def probes(raw: str, path: str, aliases: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(kind, key) of all places that ``raw`` may name when ``path`` imports it, best first, each once."""
    return list(dict.fromkeys(_probes(raw, path.replace("\\", "/"), aliases or {})))


def _probes(raw: str, path: str, aliases: dict[str, str]) -> Iterator[tuple[str, str]]:
    folder = P.parent(path)
    if not raw:
        return
    if folder is not None:
        if (m := re.match(r"(self|super)(?:::|/)(.+)", raw, re.S)) is not None:
            yield from relative(m[2] if m[1] == "self" else f"../{m[2]}", folder)
        dots = len(raw) - len(raw.lstrip("."))
        if dots and raw[dots : dots + 1] != "/":
            yield from relative("../" * (dots - 1) + raw[dots:].replace(".", "/"), folder)
    text = slashed(raw)
    if not text:
        return
    if re.match(r"\.[/.]", text):
        yield from relative(text, folder or "")
    if (found := aliased(text, aliases)) is not None:
        yield from anywhere(found)
    if is_stdlib(raw, path):
        return
    yield from anywhere(text)
    if "." in text:
        yield from anywhere(text.replace(".", "/"))
    if folder:
        yield from anywhere(f"{folder}/{text}")


def path_index(files: DataFrame) -> DataFrame:
    """(kind, key, target) of each path of ``files`` (path)."""
    return files.select(F.lit(PATH).alias("kind"), F.col("path").alias("key"), F.col("path").alias("target"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(kind, key, target) of each suffix of an extensionless path that only one file has; index files also stand for their directory."""
    own = F.split(P.strip_extension_col(F.col("path")), "/")
    above = P.parent_col(F.col("path"))
    stems = F.when(P.is_index_col(F.col("path")) & above.isNotNull(), F.array(own, F.split(P.strip_extension_col(above), "/"))).otherwise(F.array(own))
    cut_off = F.transform(F.sequence(F.lit(1), F.size("stem")), lambda k: F.array_join(F.slice("stem", k, F.size("stem")), "/"))
    keys = files.select("path", F.explode(stems).alias("stem")).select("path", F.explode(cut_off).alias("key"))
    one = keys.groupBy("key").agg(F.min("path").alias("target"), F.max("path").alias("other")).where(F.col("target") == F.col("other"))
    return one.select(F.lit(SUFFIX).alias("kind"), "key", "target")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, seq, target) of the imports (from_file, seq, probes: array of kind and key) that name a file of ``files``."""
    wanted = imports.select("from_file", "seq", F.posexplode("probes").alias("rank", "probe")).select("from_file", "seq", "rank", "probe.kind", "probe.key")
    index = path_index(files).unionAll(suffix_index(files))
    return wanted.join(index, ["kind", "key"]).groupBy("from_file", "seq").agg(F.min_by("target", "rank").alias("target"))


def first_seen(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each combination of ``keys`` once, with its least ``seq``."""
    return edges.groupBy(*keys).agg(F.min("seq").alias("seq"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, to_file, seq): distinct edges between files, none from a file to itself."""
    found = resolved(imports, files).select("from_file", F.col("target").alias("to_file"), "seq").where("from_file <> to_file")
    return first_seen(found, ["from_file", "to_file"])
