"""The one Python stage: source files in, one nested row per file out, then flat tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.functions import paths as P
from codehealth.operators.extract import extract
from codehealth.operators.resolve import probes

COMMENT = r"^(?://|#|--|;|%|'''|\"\"\"|/\*|<!--|\{-)"
#: Functions of one file have numbers from its number times this on.
FILE_STEP = 1 << 20

STAGE = (
    "path string, ord int, lang string, lines int, "
    "imports array<struct<seq int, raw string, probes array<struct<kind string, key string>>>>, "
    "functions array<struct<fn_ord int, name string, start_line int, end_line int, line_count int, cyclomatic int, cognitive int, param_count int, public boolean, method boolean>>, "
    "classes array<struct<cls_ord int, name string, bases array<string>, kind string>>, "
    "calls array<struct<seq int, line int, callee string, qualified boolean, caller int>>, "
    "mentions array<struct<name string, first_in_test boolean, in_production boolean, in_test boolean>>, "
    "local_calls array<struct<caller int, callee string>>, "
    "bodies array<struct<fn_ord int, body string>>"
)


def line_counts(text: Column) -> Column:
    """struct(total, code, comments, blanks) of a text's lines; what follows the last line end counts only if it isn't empty."""
    lines = F.split(text, "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r")))
    blanks = F.size(F.filter(bare, lambda x: x == ""))
    comments = F.size(F.filter(bare, lambda x: x.rlike(COMMENT)))
    return F.struct(F.size(bare).alias("total"), (F.size(bare) - blanks - comments).alias("code"), comments.alias("comments"), blanks.alias("blanks"))


def utf8(text: str) -> str:
    """A text of one character per byte as the text that the bytes spell."""
    return text if text.isascii() else text.encode("latin-1").decode("utf-8", "replace")


def row(path: str, place: int, lang: str, lines: int, content: bytes, aliases: dict[str, str], strict: bool) -> dict:
    found = extract(path, content, lang, strict)
    imports = [{"seq": k, "raw": utf8(raw), "probes": [{"kind": a, "key": b} for a, b in probes(utf8(raw), path, aliases)]} for k, raw in enumerate(found.imports)]
    functions = [
        {"fn_ord": k, "name": f.name, "start_line": f.start, "end_line": f.end, "line_count": f.end - f.start + 1, "cyclomatic": f.cyclomatic, "cognitive": f.cognitive, "param_count": f.params, "public": f.public, "method": f.method}
        for k, f in enumerate(found.functions)
    ]
    return {
        "path": path, "ord": place, "lang": lang, "lines": lines, "imports": imports, "functions": functions,
        "classes": [{"cls_ord": k, "name": utf8(c.name), "bases": list(map(utf8, c.bases)), "kind": c.kind} for k, c in enumerate(found.classes)],
        "calls": [{"seq": k, "line": line, "callee": name, "qualified": q, "caller": f} for k, (line, name, q, f) in enumerate(found.calls)],
        "mentions": [dict(zip(("name", "first_in_test", "in_production", "in_test"), m)) for m in found.mentions],
        "local_calls": [{"caller": f, "callee": name} for f, name in found.local_calls],
        "bodies": [{"fn_ord": k, "body": body} for k, body in found.bodies],
    }


def staged(tree: DataFrame, aliases: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """One nested row per source of ``tree`` that has content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = dict(aliases or {})
    tree.sparkSession  # the DDL below is parsed with this session
    arrow = to_arrow_schema(_parse_datatype_string(STAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(p, k, lang, n, content, names, strict) for p, k, lang, n, content in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    total = line_counts(F.decode("content", "ISO-8859-1"))["total"]
    rows = tree.where("content IS NOT NULL AND import_lang IS NOT NULL").select("path", "ord", F.col("import_lang").alias("lang"), total.alias("lines"), "content")
    return rows.mapInArrow(run, STAGE)


def flat(stage: DataFrame, column: str) -> DataFrame:
    """(file, file_ord, fields of ``column``): one row per element."""
    return stage.select(F.col("path").alias("file"), F.col("ord").alias("file_ord"), F.explode(column).alias("x")).select("file", "file_ord", "x.*")


def function_id(ordinal: str) -> Column:
    return F.col("file_ord").cast("long") * FILE_STEP + F.col(ordinal)


def functions(stage: DataFrame) -> DataFrame:
    """file, file_ord, fn, fn_ord and what is known of each function; ``production`` ones are in no test file."""
    return flat(stage, "functions").withColumn("fn", function_id("fn_ord")).withColumn("production", ~P.is_test_col(F.col("file")))


def imports(stage: DataFrame) -> DataFrame:
    rows = flat(stage, "imports")
    return rows.select(F.col("file").alias("from_file"), function_id("seq").alias("seq"), "raw", "probes")


def call_sites(stage: DataFrame) -> DataFrame:
    """from_file, from_func, seq, callee, qualified of the call sites inside functions."""
    named = stage.select(F.col("path").alias("file"), F.col("ord").alias("file_ord"), "functions", F.explode("calls").alias("c")).where("c.caller IS NOT NULL")
    caller = F.col("functions")[F.col("c.caller")]["name"]
    return named.select(F.col("file").alias("from_file"), caller.alias("from_func"), (F.col("file_ord").cast("long") * FILE_STEP + F.col("c.seq")).alias("seq"), "c.callee", "c.qualified")


def local_calls(stage: DataFrame) -> DataFrame:
    return flat(stage, "local_calls").select("file", F.when(F.col("caller").isNotNull(), function_id("caller")).alias("fn"), "callee")


def bodies(stage: DataFrame) -> DataFrame:
    return flat(stage, "bodies").select("file", "file_ord", "fn_ord", function_id("fn_ord").alias("fn"), "body")


def totals(files: DataFrame) -> DataFrame:
    """One row of file_count, line_count and max_file_lines of ``files`` (lines)."""
    lines = F.col("lines")
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(lines), F.lit(0)).alias("line_count"), F.coalesce(F.max(lines), F.lit(0)).alias("max_file_lines"))
