import json

import pytest

from codehealth.plans.cli import CommandError, main, parse_options
from codehealth.plans.source_queries import PROJECT


@pytest.fixture
def tree(tmp_path):
    for path, text in PROJECT.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "_hidden.py").write_text("x = 1\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "no.py").write_text("def no(): pass\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "src" / "main.py")
    (tmp_path / "big.py").write_text("#" * (101 * 1024))
    (tmp_path / "huge.bin").write_bytes(b"x" * (600 * 1024))
    (tmp_path / "notes.txt").write_text("not a source\n")
    return tmp_path


def run(capsys, spark, *args):
    status = main(list(args), spark)
    return status, capsys.readouterr()


def test_scan_check_and_gate(spark, tree, capsys):
    status, out = run(capsys, spark, "scan", str(tree), "--json")
    scan = json.loads(out.out)
    assert status == 0 and scan["ok"] and scan["schema_version"] == 2
    assert (scan["files"], scan["functions"], scan["dead_functions"], scan["duplicate_functions"]) == (12, 17, 2, 0)
    assert (scan["import_edges"], scan["call_edges"], scan["inherit_edges"]) == (7, 3, 2)
    assert scan["depth_path"][:2] == ["src/main.py", "src/tools.py"] and scan["hotspots"][0]["name"] in ("main", "add")
    assert scan["skipped_files"] == [{"path": "huge.bin", "reason": "file_too_large"}, {"path": "big.py", "reason": "parse_too_large"}]

    assert json.loads(run(capsys, spark, "check", str(tree), "--json")[1].out)["error_info"] == {"code": "NoRulesFile", "category": "configuration", "message": "NoRulesFile"}
    assert json.loads(run(capsys, spark, "gate", str(tree), "--json")[1].out)["error_info"]["category"] == "baseline"
    (tree / ".codehealth").mkdir()
    (tree / ".codehealth" / "rules.toml").write_text('[constraints]\nmax_cyclomatic = 3\n[[boundaries]]\nfrom = "src/main.py"\nto = "src/*.py"\n')
    status, out = run(capsys, spark, "check", str(tree), "--json")
    check = json.loads(out.out)
    assert status == 1 and not check["pass"] and check["rules_checked"] == 2
    assert [(v["rule"], v["from"], v["to"], v["line"]) for v in check["violations"]] == [
        ("boundary", "src/main.py", "src/helper.py", None), ("boundary", "src/main.py", "src/tools.py", None), ("max_cyclomatic", "native/x.c", None, 3), ("max_cyclomatic", "src/main.py", None, 4),
    ]
    assert run(capsys, spark, "gate", str(tree), "--save")[0] == 0
    (tree / "src" / "more.py").write_text("def unused_one(x):\n    return x\n")
    status, out = run(capsys, spark, "gate", str(tree), "--json")
    assert status == 1 and "Dead functions increased: 2 -> 3" in json.loads(out.out)["violations"]


def test_empty_tree(spark, tmp_path, capsys):
    status, out = run(capsys, spark, "scan", str(tmp_path), "--json")
    scan = json.loads(out.out)
    assert status == 0 and scan["files"] == 0 and scan["root_causes"]["modularity"] == 10000 and scan["root_causes"]["redundancy"] == 0


def test_arguments(capsys, spark):
    assert parse_options("gate", ["--save", "--", "-x"]).path == "-x"
    for args, code in ((["x"], "UnknownCommand"), (["scan", "--bad"], "UnknownFlag"), (["scan", "--save"], "InvalidFlag"), (["scan", "--json", "--json"], "DuplicateFlag"), (["scan", "a", "b"], "ExtraArgument"), (["scan", ""], "InvalidPath")):
        with pytest.raises(CommandError) as e:
            parse_options(args[0], args[1:])
        assert e.value.code == code
    assert main([]) == 2 and main(["--version"]) == 0 and main(["--help", "x"]) == 2
    assert run(capsys, spark, "scan", "/no/such/folder", "--json")[0] == 2
