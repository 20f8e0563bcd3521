"""Extraction and resolution on a small project whose answers are worked out by hand."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.operators import graph, links, resolve, stage, stats
from codehealth.plans import cli
from codehealth.plans.analysis import flagged_functions
from codehealth.session import new_dir
from codehealth.sources.baseline import BaselineError, loads
from codehealth.sources.languages import import_language
from codehealth.sources.manifests import aliases
from codehealth.sources.rulefile import InvalidRules, parse_rules
from codehealth.sources.toml import TomlError
from codehealth.sources.tree import RootError, TreeReader, read_tree

PROJECT = {
    "go/m.go": """package m
import (
    "fmt"
    u "x/go/util"
)
type Point struct { x int }
func (p Point) Norm(q int) int { return p.x }
func helper() { fmt.Println(Use(1)) }
""",
    "go/util.go": "package m\nfunc Use(n int) int { return n }\n",
    "native/x.c": """#include "y.h"
#include <stdio.h>
static int add(int a, int b) {
  switch (a) { case 1: return b; case 2: return a; }
  return a || b;
}
void go_on(void) {
  add(1, 2);
}
""",
    "native/y.h": "int add(int a, int b);\n",
    "rs/lib.rs": """pub mod shapes;
use crate::shapes::{Area, Square};
pub fn total(items: &[i32], f: fn(i32) -> i32) -> i32 {
    items.iter().map(|x| f(*x)).sum()
}
""",
    "rs/shapes.rs": """pub trait Area { fn area(&self) -> i32; }
pub struct Square<T> { side: T }
impl<T> Area for Square<T> {
    fn area(&self) -> i32 { 4 }
}
""",
    "src/helper.py": """class Base:
    def size(self):
        return 1

def twice(n):
    return n * 2
""",
    "src/main.py": '''import os, helper as h
from .tools import run

def main(argv, verbose=False):
    """doc if while"""
    if verbose and argv:
        for a in argv:
            run(a)
    return h.twice(2)

def orphan(x):
    return x  # main(
''',
    "src/tools.py": """from helper import Base

class Tool(Base):
    def run(self, what):
        while what or 0:
            what = step(what)

def run(what):
    return Tool().run(what)

def step(what):
    return None
""",
    "web/app.ts": """import { view } from "./view";
export default class App extends Shape implements Drawable, ns.Other {
}
export async function start(el: string, n = [1, 2]) {
  if (el && n) { view(el); }
  /* view(el) */
}
function* idle() { yield "if (x) {"; }
""",
    "web/view.ts": "export function view(el) {\n  return `a ${el} (b`;\n}\nclass Shape {}\n",
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(columns: str, *rows: str):
    """Registers a query whose answer is ``rows``."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({columns})"
        return f

    return add


def tree(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """``files`` as the table that a source tree is read as."""
    order = sorted(files, key=lambda p: p.split("/"))
    rows = [(p, k, import_language(p), bytearray(files[p].encode())) for k, p in enumerate(order)]
    return spark.createDataFrame(rows, "path string, ord int, import_lang string, content binary")


def project(spark: SparkSession) -> DataFrame:
    return stage.staged(tree(spark, PROJECT))


def edges(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import, call and inheritance edges."""
    imports = resolve.import_edges(stage.imports(found), found.select("path"))
    functions = stage.functions(found).withColumn("place", F.col("fn"))
    classes = stage.flat(found, "classes").withColumn("seq", stage.function_id("cls_ord"))
    return imports, links.call_edges(stage.call_sites(found), functions, imports), links.inherit_edges(classes, imports)


@query(
    "file, place, raw", "'go/m.go', 0, 'fmt'", "'go/m.go', 1, 'x/go/util'", "'native/x.c', 0, 'y.h'", "'rs/lib.rs', 0, 'shapes'", "'rs/lib.rs', 1, 'crate::shapes'",
    "'src/main.py', 0, 'os'", "'src/main.py', 1, 'helper'", "'src/main.py', 2, '.tools'", "'src/tools.py', 0, 'helper'", "'web/app.ts', 0, './view'",
)
def source_imports(spark: SparkSession, d: str) -> DataFrame:
    return stage.flat(project(spark), "imports").select("file", F.col("seq").alias("place"), "raw")


@query(
    "file, name, start_line, end_line, cyclomatic, cognitive, param_count, public, method",
    "'go/m.go', 'Norm', 7, 7, 1, 0, 1, true, true", "'go/m.go', 'helper', 8, 8, 1, 0, 0, false, false", "'go/util.go', 'Use', 2, 2, 1, 0, 1, true, false",
    "'native/x.c', 'add', 3, 6, 4, 3, 2, false, false", "'native/x.c', 'go_on', 7, 9, 1, 0, 1, true, false", "'rs/lib.rs', 'total', 3, 5, 1, 0, 2, true, false",
    "'rs/shapes.rs', 'area', 4, 4, 1, 0, 0, false, true", "'src/helper.py', 'size', 2, 3, 1, 0, 0, false, true", "'src/helper.py', 'twice', 5, 6, 1, 0, 1, false, false",
    "'src/main.py', 'main', 4, 9, 4, 5, 2, false, false", "'src/main.py', 'orphan', 11, 12, 1, 0, 1, false, false", "'src/tools.py', 'run', 4, 6, 3, 3, 1, false, true",
    "'src/tools.py', 'run', 8, 9, 1, 0, 1, false, false", "'src/tools.py', 'step', 11, 12, 1, 0, 1, false, false", "'web/app.ts', 'start', 4, 7, 3, 2, 2, true, false",
    "'web/app.ts', 'idle', 8, 8, 1, 0, 0, false, false", "'web/view.ts', 'view', 1, 3, 1, 0, 1, true, false",
)
def source_functions(spark: SparkSession, d: str) -> DataFrame:
    return stage.functions(project(spark)).select("file", "name", "start_line", "end_line", "cyclomatic", "cognitive", "param_count", "public", "method")


@query(
    "file, name, bases, kind", "'go/m.go', 'Point', '', 'struct'", "'rs/shapes.rs', 'Area', '', 'trait'", "'rs/shapes.rs', 'Square', '', 'struct'", "'rs/shapes.rs', 'Square', 'Area', 'struct'",
    "'src/helper.py', 'Base', '', 'class'", "'src/tools.py', 'Tool', 'Base', 'class'", "'web/app.ts', 'App', 'Shape,Drawable,Other', 'class'", "'web/view.ts', 'Shape', '', 'class'",
)
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    return stage.flat(project(spark), "classes").select("file", "name", F.array_join("bases", ",").alias("bases"), "kind")


@query(
    "file, line, callee, qualified", "'go/m.go', 2, 'import', false", "'native/x.c', 8, 'add', false", "'rs/lib.rs', 4, 'iter', true", "'rs/lib.rs', 4, 'map', true", "'rs/lib.rs', 4, 'f', false",
    "'rs/lib.rs', 4, 'sum', true", "'rs/shapes.rs', 1, 'area', false", "'src/main.py', 8, 'run', false", "'src/main.py', 9, 'twice', true", "'src/tools.py', 3, 'Tool', false",
    "'src/tools.py', 6, 'step', false", "'src/tools.py', 9, 'Tool', false", "'src/tools.py', 9, 'run', true", "'web/app.ts', 5, 'view', false", "'native/y.h', 1, 'add', false",
)
def source_calls(spark: SparkSession, d: str) -> DataFrame:
    return stage.flat(project(spark), "calls").select("file", "line", "callee", "qualified")


@query(
    "from_file, to_file", "'src/main.py', 'src/helper.py'", "'src/main.py', 'src/tools.py'", "'src/tools.py', 'src/helper.py'", "'web/app.ts', 'web/view.ts'",
    "'native/x.c', 'native/y.h'", "'rs/lib.rs', 'rs/shapes.rs'", "'go/m.go', 'go/util.go'",
)
def source_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(project(spark))[0].select("from_file", "to_file")


@query(
    "from_file, from_func, to_file, to_func", "'src/main.py', 'main', 'src/tools.py', 'run'", "'src/main.py', 'main', 'src/helper.py', 'twice'", "'web/app.ts', 'start', 'web/view.ts', 'view'"
)
def source_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(project(spark))[1].drop("seq")


@query("child_file, child_class, parent_file, parent_class", "'src/tools.py', 'Tool', 'src/helper.py', 'Base'", "'web/app.ts', 'App', 'web/view.ts', 'Shape'")
def source_inherit_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(project(spark))[2].drop("seq")


@query("file, name", "'src/main.py', 'orphan'", "'web/app.ts', 'idle'")
def source_dead_functions(spark: SparkSession, d: str) -> DataFrame:
    found = project(spark)
    return flagged_functions(found, stage.functions(found), edges(found)[1]).where("dead").select("file", "name")


COPIES = {
    "a/one.js": "function first(x) {\n  return x + 1; // add one to it\n}\nexport const k = first(2);\n",
    "a/two.js": "function second(x) {\n  return x +   1; /* the same */\n}\nsecond(3);\n",
    "a/three.js": "function third(x) {\n  return x + 2; // add one to it\n}\nthird(3);\nfunction tiny() {\n}\ntiny();\n",
    "b/four.js": "function small() {\n}\nsmall();\n",
    "tests/five.js": "function fifth(x) {\n  return x + 1;\n}\n",
}


@query("file, name, duplicate, dead, production", "'a/one.js', 'first', false, false, true", "'a/two.js', 'second', false, false, true", "'a/three.js', 'third', false, false, true", "'a/three.js', 'tiny', false, false, true", "'b/four.js', 'small', false, false, true", "'tests/five.js', 'fifth', false, false, false")
def source_short_bodies(spark: SparkSession, d: str) -> DataFrame:
    found = stage.staged(tree(spark, COPIES))
    return flagged_functions(found, stage.functions(found), edges(found)[1]).select("file", "name", "duplicate", "dead", "production")


LONG_COPIES = {k: v.replace("return x", "return helper.plus(x)") for k, v in COPIES.items()}


@query("file, name, duplicate", "'a/one.js', 'first', false", "'a/two.js', 'second', true", "'a/three.js', 'third', false", "'a/three.js', 'tiny', false", "'b/four.js', 'small', false", "'tests/five.js', 'fifth', false")
def source_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = stage.staged(tree(spark, LONG_COPIES))
    return flagged_functions(found, stage.functions(found), edges(found)[1]).select("file", "name", "duplicate")


# Reading a tree: what the walk finds, leaves out and skips.

BIG, HUGE = 100 * 1024, 512 * 1024
TREE = {
    "main.py": b"import os\n", "_under.py": b"x = 1\n", ".hidden.js": b"let x\n", "a/b.txt": b"text\n", "a/empty.rs": b"", "a/Zed.go": b"package a\n", "a.b/c.zig": b"const x = 1;\n", "big.py": b"#" * (BIG + 1), "edge.py": b"#" * BIG,
    "huge.bin": b"x" * (HUGE + 1), "edge.bin": b"x" * HUGE, "big.md": b"m" * (BIG + 1), "Makefile": b"all:\n", "target/out.rs": b"fn x() {}\n", "a/node_modules/m.js": b"x\n", ".git/config.py": b"x\n", "vendor/v.go": b"package v\n",
}


def made_tree(spark: SparkSession, files: dict[str, bytes], links: tuple = ()) -> str:
    """A folder of ``files`` in the shared folder, with links (name, path) to some of them."""
    root = urlparse(new_dir(spark, "tree")).path
    for path, data in files.items():
        place = os.path.join(root, path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "wb") as f:
            f.write(data)
    for name, path in links:
        os.symlink(os.path.join(root, path), os.path.join(root, name))
    return root


def example_tree(spark: SparkSession) -> DataFrame:
    return read_tree(spark, made_tree(spark, TREE, (("link.py", "main.py"), ("linked", "a"))))


@query(
    "path, ord, name, lang, size, skipped, bytes_read",
    "'.hidden.js', 0, '.hidden.js', 'javascript', 6, NULL, 6", "'Makefile', 1, 'Makefile', 'makefile', 5, NULL, NULL", "'_under.py', 2, '_under.py', 'python', 6, NULL, 6",
    "'a/Zed.go', 3, 'Zed.go', 'go', 10, NULL, 10", "'a/b.txt', 4, 'b.txt', 'text', 5, NULL, NULL", "'a/empty.rs', 5, 'empty.rs', 'rust', 0, NULL, 0", "'a.b/c.zig', 6, 'c.zig', 'zig', 13, NULL, 13",
    "'big.md', 7, 'big.md', 'markdown', 102401, NULL, NULL", "'big.py', 8, 'big.py', 'python', 102401, 'parse_too_large', NULL", "'edge.bin', 9, 'edge.bin', 'unknown', 524288, NULL, NULL",
    "'edge.py', 10, 'edge.py', 'python', 102400, NULL, 102400", "'huge.bin', 11, 'huge.bin', 'unknown', 524289, 'file_too_large', NULL", "'main.py', 12, 'main.py', 'python', 10, NULL, 10",
)
def tree_files(spark: SparkSession, d: str) -> DataFrame:
    return example_tree(spark).select("path", "ord", "name", "lang", "size", "skipped", F.octet_length("content").alias("bytes_read"))


@query("file_count, line_count, max_file_lines", "7, 6, 1")
def tree_totals(spark: SparkSession, d: str) -> DataFrame:
    return stage.totals(stage.staged(example_tree(spark)))


@query("root, error", "'file', 'RootError'", "'nothing', 'RootError'", "'folder', 'none'")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    root = made_tree(spark, {"sub/x.py": b"x\n"})
    out = []
    for name, path in (("file", "sub/x.py"), ("nothing", "gone"), ("folder", "sub")):
        try:
            TreeReader({"path": os.path.join(root, path)}).partitions()
            out.append((name, "none"))
        except RootError as error:
            out.append((name, type(error).__name__))
    return spark.createDataFrame(out, "root string, error string")


PACKAGES = {
    "core/Cargo.toml": b'[package]\nname = "my-core"\n', "core/src/lib.rs": b"pub mod shape;\n", "core/src/shape.rs": b"pub fn area() {}\n", "app/src/run.rs": b"use my_core::shape;\nfn go() {}\n",
    "ui/package.json": b'{"name": "@x/ui", "main": "src/index.ts"}', "ui/src/index.ts": b"export const a = 1;\n", "web/page.ts": b'import { a } from "@x/ui";\n', "lost/package.json": b'{"name": "gone", "main": "no.js"}',
}


def package_tree(spark: SparkSession) -> DataFrame:
    return read_tree(spark, made_tree(spark, PACKAGES), manifests=True)


@query("name, root_file", "'my_core', 'core/src/lib.rs'", "'@x/ui', 'ui/src/index.ts'")
def manifest_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(aliases(package_tree(spark)).items()), "name string, root_file string")


@query("from_file, to_file", "'core/src/lib.rs', 'core/src/shape.rs'", "'app/src/run.rs', 'core/src/shape.rs'", "'web/page.ts', 'ui/src/index.ts'")
def aliased_edges(spark: SparkSession, d: str) -> DataFrame:
    found = package_tree(spark)
    return edges(stage.staged(found, aliases(found)))[0].select("from_file", "to_file")


# Depth of graphs with cycles, inequality without functions, configuration.

CYCLIC = {
    "ring": ([(0, 1), (1, 2), (2, 0)], [0]), "tail": ([(0, 1), (1, 0), (1, 2), (2, 3)], [0]), "loop": ([(0, 0), (0, 1)], [0]), "two": ([(0, 1), (1, 0), (2, 3), (3, 4), (4, 2)], [0, 2]), "none": ([], [0]),
}


@query("graph, depth, path", "'ring', 2, '0,1,2'", "'tail', 3, '0,1,2,3'", "'loop', 1, '0,1'", "'two', 2, '2,3,4'", "'none', 0, '0'")
def cyclic_depth(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for name, (pairs, begin) in CYCLIC.items():
        edges_ = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src long, dst long, seq long")
        depth, path = graph.longest_path(spark.createDataFrame([(v, v) for v in begin], "id long, ord long"), edges_, False)
        out.append((name, depth, ",".join(map(str, path))))
    return spark.createDataFrame(out, "graph string, depth long, path string")


@query("source, gini", "'functions', 0.25::DOUBLE", "'files', 0.5", "'nothing', 0.0")
def equality_source(spark: SparkSession, d: str) -> DataFrame:
    functions, files = spark.createDataFrame([(1,), (3,)], "cyclomatic int"), spark.createDataFrame([(0,), (8,)], "lines int")
    cases = {"functions": (functions, files), "files": (functions.limit(0), files), "nothing": (functions.limit(0), files.limit(0))}
    return spark.createDataFrame([(k, round(float(stats.inequality(*v)), 6)) for k, v in cases.items()], "source string, gini double")


RULE_FILES = {
    "empty": "", "good": "[constraints]\nmin_quality = 1\n", "unknown key": "[constraints]\nmin_size = 1\n", "score above one": "[constraints]\nmin_depth = 1.5\n", "count below zero": "[constraints]\nmax_cycles = -1\n",
    "key twice": "[constraints]\nmax_cycles = 1\nmax_cycles = 1\n", "two layers of a name": '[[layers]]\nname = "a"\npaths = ["x/**"]\norder = 0\n[[layers]]\nname = "a"\npaths = ["y/**"]\norder = 1\n',
    "layer without order": '[[layers]]\nname = "a"\npaths = ["x/**"]\n', "rooted glob": '[[boundaries]]\nfrom = "/x"\nto = "y"\n', "two stars": '[[boundaries]]\nfrom = "a*b*c"\nto = "y"\n', "backslashes": '[[boundaries]]\nfrom = "a\\b"\nto = "y"\n',
    "boundary twice": '[[boundaries]]\nfrom = "x"\nto = "y"\n[[boundaries]]\nfrom = "x"\nto = "y"\n', "unknown section": "[other]\nx = 1\n",
}


@query(
    "file, result", "'empty', 'ok'", "'good', 'ok'", "'unknown key', 'InvalidRules'", "'score above one', 'InvalidRules'", "'count below zero', 'InvalidRules'", "'key twice', 'InvalidRules'", "'two layers of a name', 'InvalidRules'",
    "'layer without order', 'InvalidRules'", "'rooted glob', 'InvalidRules'", "'two stars', 'InvalidRules'", "'backslashes', 'ok'", "'boundary twice', 'InvalidRules'", "'unknown section', 'InvalidRules'",
)
def rule_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, outcome(parse_rules, v)) for k, v in RULE_FILES.items()], "file string, result string")


BASELINES = {
    "defaults": "{}", "good": '{"schema_version": 1, "quality_signal": 0.5, "total_functions": 3, "duplicate_functions": 2}', "other schema": '{"schema_version": 2}', "no object": "[]", "not closed": "{", "unknown key": '{"x": 1}', "signal above one": '{"quality_signal": 1.5}',
    "more dead than all": '{"dead_functions": 1}', "all duplicates": '{"total_functions": 2, "duplicate_functions": 2}', "below zero": '{"max_depth": -1}', "text": '{"cycle_count": "1"}',
}


@query(
    "file, result", "'defaults', 'ok'", "'good', 'ok'", "'other schema', 'UnsupportedBaselineSchema'", "'no object', 'InvalidBaseline'", "'not closed', 'InvalidBaseline'", "'unknown key', 'InvalidBaseline'", "'signal above one', 'InvalidBaseline'",
    "'more dead than all', 'InvalidBaseline'", "'all duplicates', 'InvalidBaseline'", "'below zero', 'InvalidBaseline'", "'text', 'InvalidBaseline'",
)
def baseline_files(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, outcome(loads, v)) for k, v in BASELINES.items()], "file string, result string")


def outcome(read: Callable, text: str) -> str:
    """The code of the error that reading the text ends with, or ok."""
    try:
        read(text)
    except (InvalidRules, BaselineError, TomlError) as error:
        return getattr(error, "code", type(error).__name__)
    return "ok"


@query("command, status, shown", "'scan', 0, 'files=12 functions=17 dead=2 imports=7 calls=3 inherits=2'", "'check', 1, 'rules=2 violations=4'", "'save', 0, 'saved=true'", "'gate', 0, 'pass=true violations=0'")
def commands(spark: SparkSession, d: str) -> DataFrame:
    """The commands' JSON on the project, whose answers are worked out by hand."""
    files = {k: v.encode() for k, v in PROJECT.items()} | {"extra.py": b"x = 1\n", cli.CONFIG_DIR + "/rules.toml": b'[constraints]\nmax_cyclomatic = 3\n[[boundaries]]\nfrom = "src/main.py"\nto = "src/*.py"\n'}
    root = made_tree(spark, files)
    scan, _, a = cli.run(spark, cli.Options("scan", root))
    check, _, b = cli.run(spark, cli.Options("check", root))
    saved, _, c = cli.run(spark, cli.Options("gate", root, save=True))
    gate, _, e = cli.run(spark, cli.Options("gate", root))
    rows = [
        ("scan", a, f"files={scan['files']} functions={scan['functions']} dead={scan['dead_functions']} imports={scan['import_edges']} calls={scan['call_edges']} inherits={scan['inherit_edges']}"),
        ("check", b, f"rules={check['rules_checked']} violations={len(check['violations'])}"), ("save", c, f"saved={str(saved['saved']).lower()}"), ("gate", e, f"pass={str(gate['pass']).lower()} violations={len(gate['violations'])}"),
    ]
    return spark.createDataFrame(rows, "command string, status int, shown string")
