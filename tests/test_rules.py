import pytest

from codehealth.functions.globs import glob_match
from codehealth.operators import rules as R
from codehealth.sources import baseline as B
from codehealth.sources import toml
from codehealth.sources.manifests import Alias, aliases, named
from codehealth.sources.rulefile import Boundary, InvalidRules, Layer, Rules, parse_rules

GOOD = """
# a comment
[constraints]
min_quality = 0.5 # and one here
min_depth = 1
max_cycles = 0
[[layers]]
name = "low"
paths = ["src/core/**", "lib#1/*"]
order = 0
[[layers]]
name = "high"
paths = ["src/ui/**"]
order = 1
[[boundaries]]
from = "src/core/**"
to = "src/ui/**"
reason = "a \\"quoted\\" one"
"""


def test_rules():
    found = parse_rules(GOOD)
    assert found.floors == {"min_quality": 0.5, "min_depth": 1.0} and found.ceilings == {"max_cycles": 0}
    assert found.layers == (Layer("low", ("src/core/**", "lib#1/*"), 0), Layer("high", ("src/ui/**",), 1))
    assert found.boundaries == (Boundary("src/core/**", "src/ui/**", 'a \\"quoted\\" one'),) and R.rules_checked(found) == 5


@pytest.mark.parametrize(
    "text",
    [
        "x = 1", "[other]\na = 1", "[constraints]\nmin_quality = 2", "[constraints]\nmax_cycles = 0.5", "[constraints]\nmax_cycles = 1\nmax_cycles = 1", "[constraints]\n[constraints]",
        "[constraints]\nmin_quality", "[constraints]\nmin_quality = 'a'", '[[layers]]\nname = "a"\npaths = []\norder = 0', '[[layers]]\nname = "a b"\npaths = ["x"]\norder = 0',
        '[[layers]]\nname = "a"\npaths = ["x", "x"]\norder = 0', '[[layers]]\nname = "a"\npaths = ["/x"]\norder = 0', '[[layers]]\nname = "a"\npaths = ["a*b*"]\norder = 0',
        '[[layers]]\nname = "a"\npaths = ["x"]', '[[boundaries]]\nfrom = "a"', '[[boundaries]]\nfrom = "a"\nto = "b"\nmore = 1', '[[boundaries]]\nfrom = "a[b]"\nto = "b"', "[layers]\na = 1", '[constraints',
    ],
)
def test_bad_rules(text):
    with pytest.raises(InvalidRules):
        parse_rules(text)


def test_toml_values():
    tables = toml.parse('a = 1\n[s]\nb = -2.5e1\nc = true\nd = ["x,y", 3, [1]]\n[[t]]\ne = "#"\n[[t]]')
    assert tables[""].values == {"a": 1} and tables["s"].values == {"b": -25.0, "c": True, "d": ["x,y", 3, [1]]} and tables["t"].entries == [{"e": "#"}, {}]
    for text, code in (("a", "MissingAssignment"), ("= 1", "InvalidKey"), ("a =", "EmptyValue"), ("a = b", "InvalidValue"), ('a = "b', "UnterminatedString"), ('a = "b" "c"', "InvalidString"), ("a = 'b'", "UnsupportedString"), ("a = 1\na = 2", "DuplicateKey"), ("a = [1", "UnterminatedArray")):
        with pytest.raises(toml.TomlError) as e:
            toml.parse(text)
        assert e.value.code == code


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("src/**", "src/a/b.c", True), ("src/**", "src", True), ("src/**", "srcs/a", False), ("*.c", "a/b.c", True), ("a/*.c", "a/b/c.c", False), ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True),
        ("src/core", "src/core/x", True), ("src/core", "src/cores", False), ("a/?.c", "a/é.c", True), ("a/?.c", "a/xy.c", False), ("**", "any/thing", True), ("a/\\*", "a/*", True), ("a/\\*", "a/x", False),
        ("a\\b", "a/b", True), ("core", "x/core", True), ("core", "core/x", False), ("**/x/**", "a/x", True), ("a+b/(c)", "a+b/(c)/d", True),
    ],
)
def test_globs(pattern, path, hit):
    assert glob_match(pattern, path) is hit


def health(spark, **more):
    row = {"quality_signal": 0.4, "modularity": 0.5, "acyclicity": 0.5, "depth": 0.5, "equality": 0.5, "redundancy": 0.5, "cycle_count": 1, "max_file_lines": 5, "max_fn_lines": 5}
    return spark.createDataFrame([row | more])


def test_check(spark):
    rules = Rules({"min_quality": 0.5, "min_acyclicity": 0.9}, {"max_cycles": 1, "max_cyclomatic": 10}, (Layer("low", ("a/**",), 0), Layer("high", ("b/**",), 1)), (Boundary("b/*", "a/*", "no"), Boundary("**", "a/x", "")))
    fns = spark.createDataFrame([("a/x", "f", 9, 11, 0), ("a/x", "g", 20, 40, 0), ("b/y", "h", 1, 10, 0)], "file string, name string, start_line int, cyclomatic int, cognitive int")
    edges = spark.createDataFrame([("b/y", "a/x"), ("a/x", "b/y"), ("b/y", "a/x")], "`from` string, `to` string")
    paths = spark.createDataFrame([("a/x",), ("b/y",)], "path string")
    got = [(v["rule"], v["message"], v["line"]) for v in R.check(rules, health(spark), fns, edges, paths).collect()]
    assert got == [
        ("boundary", "b/y must not import a/x", None), ("boundary", "b/y must not import a/x — no", None), ("layer_order", "layer 'high' (order 1) imports 'low' (order 0)", None),
        ("max_cyclomatic", "a/x:9: f has cyclomatic complexity 11 > allowed 10", 9), ("max_cyclomatic", "a/x:20: g has cyclomatic complexity 40 > allowed 10", 20),
        ("min_acyclicity", "acyclicity 0.500 < required 0.900 (1 cycles)", None), ("min_quality", "quality 0.400 < required 0.500", None),
    ]
    with pytest.raises(R.AmbiguousLayer):
        R.check(Rules(layers=(Layer("p", ("a/**",), 0), Layer("q", ("a/x",), 1))), health(spark), fns, edges, paths)
    with pytest.raises(R.BadInput):
        R.check(Rules(), health(spark), fns, edges, spark.createDataFrame([("a/../x",)], "path string"))


def test_gate(spark):
    rows = [B.Baseline(1, q, 1, 2, 10, 1, d) for q, d in ((0.8, 1), (0.7, 2), (0.79, 1))]
    frames = [spark.createDataFrame([b.__dict__]) for b in rows]
    assert [r["message"] for r in R.regressions(frames[0], frames[1]).collect()] == ["Quality signal dropped: 0.800 -> 0.700", "Duplicated functions increased: 1 -> 2"]
    assert R.regressions(frames[0], frames[2]).collect() == []


def test_baseline(tmp_path):
    b = B.Baseline(1, 0.5, 1, 2, 10, 3, 2)
    B.save(b, str(tmp_path / "c" / "baseline.json"))
    assert B.loads((tmp_path / "c" / "baseline.json").read_text()) == b and B.loads("{}") == B.Baseline()
    for bad in ("[]", "{", '{"x": 1}', '{"quality_signal": 2}', '{"dead_functions": 1}', '{"total_functions": 2, "duplicate_functions": 2}', '{"max_depth": -1}', '{"max_depth": "1"}'):
        with pytest.raises(B.BaselineError):
            B.loads(bad)


def test_manifests(spark):
    found = {
        "Cargo.toml": b'[package]\nname = "my-app"\n[lib]\nname = "app_lib"\npath = "src/x.rs"\n', "sub/package.json": b'{"name": "@a/b", "main": "m.js"}', "bad/Cargo.toml": b"[[", "more/package.json": b'{"name": "c", "version": "1"}',
        "a/node_modules/package.json": b'{"name": "d"}', "z/package.json": b'{"name": "gone"}',
    }
    files = ["src/x.rs", "sub/m.js", "more/index.js"]
    assert named(found.items()) == [Alias("app_lib", "src/x.rs"), Alias("my_app", "src/x.rs"), Alias("@a/b", "sub/m.js"), Alias("gone", "z/index.js")]
    rows = [(p, k, p.rpartition("/")[2], bytearray(found.get(p, b"x"))) for k, p in enumerate([*found, *files])]
    tree = spark.createDataFrame(rows, "path string, ord int, name string, content binary")
    assert aliases(tree) == {"app_lib": "src/x.rs", "my_app": "src/x.rs", "@a/b": "sub/m.js"}
    assert aliases(tree.where("path = 'src/x.rs'")) == {}
