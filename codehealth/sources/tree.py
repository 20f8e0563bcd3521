"""A source tree as a table: a Python data source that lists on the driver and reads on the executors.

Unlike Spark's binary files it keeps hidden and underscored names, follows no links, and
prunes excluded directories before it descends. The root must be a path that driver and
executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codehealth.functions.paths import canonical
from codehealth.sources.languages import EXCLUDED_DIRS, import_language, language_of
from codehealth.sources.manifests import MANIFEST_BYTES, MANIFESTS

#: Limits in bytes: of a file that is listed as read, of a source that is parsed, of any read.
FILE_BYTES, PARSE_BYTES, READ_BYTES = 512 * 1024, 100 * 1024, 2 * 1024 * 1024
#: Further directory names that are skipped.
MORE_EXCLUDED = (".git", "node_modules", "target", "__pycache__", ".zig-cache")
FILES_PER_TASK = 256
SCHEMA = "path string, ord int, name string, lang string, import_lang string, size long, content binary"


class RootError(OSError):
    """The root can't be opened as a directory."""


def listed(root: str, excluded: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(path below root, bytes) of regular files, depth first, names in byte order in each directory."""
    stack: list[tuple[str, str]] = [("", root)]
    while stack:
        below, at = stack.pop()
        if os.path.isfile(at) and below:
            yield below, os.stat(at, follow_symlinks=False).st_size
            continue
        with os.scandir(at) as entries:
            found = [e for e in entries if e.is_file(follow_symlinks=False) or e.is_dir(follow_symlinks=False) and e.name not in excluded]
        found.sort(key=lambda e: os.fsencode(e.name), reverse=True)
        stack += [(f"{below}/{e.name}" if below else e.name, e.path) for e in found]


def skip_reason(size: Column, parsed: Column, file_bytes: int = FILE_BYTES, parse_bytes: int = PARSE_BYTES) -> Column:
    """Why a file's content isn't read: it is too large, or ``parsed`` and too large for that; null if it is read."""
    return F.when(size > min(file_bytes, READ_BYTES), "file_too_large").when(parsed & (size > parse_bytes), "parse_too_large")


class Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        more = options.get("exclude_dirs")
        self.excluded = frozenset(EXCLUDED_DIRS) | frozenset(more.split(",") if more else MORE_EXCLUDED)
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.parse_bytes = int(options.get("parse_bytes", PARSE_BYTES))
        self.manifests = options.get("manifests", "false").lower() == "true"

    def partitions(self) -> list[Chunk]:
        if not os.path.isdir(self.root):
            raise RootError(self.root)
        files = [(canonical(p), k, n) for k, (p, n) in enumerate(listed(self.root, self.excluded))]
        return [Chunk(files[k : k + FILES_PER_TASK]) for k in range(0, len(files), FILES_PER_TASK)] or [Chunk([])]

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        for path, place, size in chunk.files:
            lang = import_language(path)
            content = None
            wanted = lang and size <= self.parse_bytes or self.manifests and os.path.basename(path) in MANIFESTS and size <= MANIFEST_BYTES
            if wanted and size <= min(self.file_bytes, READ_BYTES):
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read(READ_BYTES)
            yield path, place, os.path.basename(path), language_of(path), lang, size, content


class SourceTree(DataSource):
    """``spark.read.format("sourcetree").load(root)``; options exclude_dirs, file_bytes, parse_bytes and manifests."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, file_bytes: int = FILE_BYTES, parse_bytes: int = PARSE_BYTES, **options) -> DataFrame:
    """One row per regular file of the tree; content only of sources that are parsed, and of manifests if asked for."""
    spark.dataSource.register(SourceTree)
    given = {k: str(v) for k, v in {"file_bytes": file_bytes, "parse_bytes": parse_bytes, **options}.items()}
    rows = spark.read.format("sourcetree").options(**given).load(root)
    return rows.withColumn("skipped", skip_reason(F.col("size"), F.col("import_lang") != "", file_bytes, parse_bytes))
