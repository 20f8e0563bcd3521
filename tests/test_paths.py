import pytest

from codehealth.functions import paths as P


def test_canonical():
    assert P.canonical("a//b/./c/../d\\e") == "a/b/d/e" and P.canonical("") == ""
    for bad in ("/a", "\\a", "C:x", "..", "a/../../b", "a\0b"):
        with pytest.raises(P.InvalidPath):
            P.canonical(bad)


@pytest.mark.parametrize(
    "path, module",
    [("db.x", "db"), ("src/main.x", "src/main"), ("lib/a.b.c", "lib/a.b"), ("analysis/s.x", "analysis"), ("src/layout/t.x", "src/layout"), ("src/a/b/s.x", "src/a/b"), ("src/a/b/c/d.x", "src/a/b"), ("a\\b", "a")],
)
def test_module(path, module):
    assert P.module_of(path) == module


def test_parts():
    assert P.strip_extension("a.b/c") == "a.b/c" and P.strip_extension("a/.x") == "a/" and P.extension("a/.x") == "x" and P.extension("a.b/c") == ""
    assert P.parent("a") is None and P.parent("a/b/c") == "a/b" and P.file_name("a\\b") == "b"


def test_kinds():
    assert all(map(P.is_entry, ("main.py", "x/main.rs", "build.zig", "a/build.zig", "x/app.py", "src/bin/tool.rs", "a/src/bin/t.zig", "index.ts")))
    assert not any(map(P.is_entry, ("app.py", "main.js", "bin/t.rs", "index.html", "mainx.py")))
    assert all(map(P.is_test, ("tests/a.py", "a/test/b", "x_test.go", "a.spec.ts", "a.b.test.c", "test-x.js", "__tests__/q", "spec.js", "a_spec/x")))
    assert not any(map(P.is_test, ("contest.py", "testing/a.py", "latest", "a/tester.js", "spec_x.js")))


def test_columns_agree_with_functions(spark):
    from pyspark.sql import functions as F

    from codehealth.plans.table_queries import PATHS

    p = F.col("p")
    rows = spark.createDataFrame([(x,) for x in PATHS], "p string").select(
        p, P.module_col(p), P.strip_extension_col(p), P.extension_col(p), P.parent_col(p), P.name_col(p), P.is_test_col(p), P.is_entry_col(p), P.is_index_col(p)
    )
    for r in rows.collect():
        x = r[0]
        assert tuple(r)[1:] == (P.module_of(x), P.strip_extension(x), P.extension(x), P.parent(x), P.file_name(x), P.is_test(x), P.is_entry(x), P.is_index(x)), x
