"""The commands scan, check and gate, with text or JSON output."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass

from pyspark.sql import SparkSession

from codehealth.operators import rules as R
from codehealth.operators.graph import GraphError
from codehealth.plans.analysis import Analysis, analyze
from codehealth.sources.baseline import Baseline, BaselineError, loads, save
from codehealth.sources.rulefile import InvalidRules, Rules, parse_rules
from codehealth.sources.toml import TomlError
from codehealth.sources.tree import READ_BYTES

SCHEMA_VERSION, TOOL_VERSION = 2, "0.1.0"
CONFIG_DIR = ".codehealth"
USAGE = """codehealth - structural health of a source tree

Usage:
  codehealth scan [path] [--json] [--aliases]
  codehealth check [path] [--json] [--aliases]
  codehealth gate [path] [--save] [--json] [--aliases]
  codehealth --help
  codehealth --version
"""
UNITS = {"quality_signal": "0-10000", "line_counts": "lines", "edge_counts": "edges"}
# The category of an error's code; others are of the analysis.
CATEGORIES = {
    "usage": ("UnknownCommand", "UnknownFlag", "InvalidFlag", "DuplicateFlag", "ExtraArgument", "InvalidPath"),
    "configuration": ("InvalidRules", "UnsupportedBaselineSchema", "InvalidBaseline", "NoRulesFile"),
    "baseline": ("NoBaseline",),
}


class CommandError(Exception):
    """An error by its code; ``exit`` is the process's exit code."""

    def __init__(self, code: str, status: int = 2):
        super().__init__(code)
        self.code, self.status = code, status


@dataclass
class Options:
    command: str
    path: str = "."
    save: bool = False
    json: bool = False
    #: Whether package names of the tree's manifests count in imports.
    aliases: bool = False


def parse_options(command: str, args: list[str]) -> Options:
    if command not in ("scan", "check", "gate"):
        raise CommandError("UnknownCommand")
    out, paths, flags, plain = Options(command), [], [], False
    for arg in args:
        if not plain and arg == "--":
            plain = True
        elif not plain and arg.startswith("-"):
            if arg not in ("--save", "--json", "--aliases"):
                raise CommandError("UnknownFlag")
            if arg == "--save" and command != "gate":
                raise CommandError("InvalidFlag")
            if arg in flags:
                raise CommandError("DuplicateFlag")
            flags.append(arg)
        elif paths:
            raise CommandError("ExtraArgument")
        elif not arg:
            raise CommandError("InvalidPath")
        else:
            paths.append(arg)
    out.path = paths[0] if paths else "."
    out.save, out.json, out.aliases = "--save" in flags, "--json" in flags, "--aliases" in flags
    return out


def category(code: str) -> str:
    return next((k for k, codes in CATEGORIES.items() if code in codes), "analysis")


def code_of(error: Exception) -> str:
    if isinstance(error, (CommandError, TomlError, GraphError, BaselineError)):
        return error.code
    known = {InvalidRules: "InvalidRules", R.AmbiguousLayer: "AmbiguousLayer", R.BadInput: "InvalidPath", FileNotFoundError: "FileNotFound", NotADirectoryError: "NotDir"}
    return next((v for k, v in known.items() if isinstance(error, k)), type(error).__name__)


def score_int(score: float) -> int:
    return int(max(0.0, min(1.0, score)) * 10000)


def envelope(ok: bool, root: str) -> dict:
    return {"schema_version": SCHEMA_VERSION, "tool_version": TOOL_VERSION, "ok": ok, "root": root, "units": UNITS}


def scan_json(root: str, a: Analysis) -> dict:
    h = a.health
    return envelope(True, root) | {
        "quality_signal": int(h["quality_signal"] * 10000), "bottleneck": h["bottleneck"], "files": h["file_count"], "lines": h["line_count"],
        "import_edges": a.import_edges.count(), "call_edges": a.call_edges.count(), "inherit_edges": a.inherit_edges.count(),
        "functions": h["total_functions"], "dead_functions": h["dead_functions"], "duplicate_functions": h["duplicate_functions"],
        "root_causes": {c: score_int(h[c]) for c in ("modularity", "acyclicity", "depth", "equality", "redundancy")},
        "depth_path": a.depth_path, "hotspots": a.hotspots, "skipped_files": [{"path": p, "reason": r} for p, r in a.skipped],
    }


def scan_text(a: Analysis) -> str:
    h = a.health
    out = [
        f"Found {h['file_count']} files, {h['line_count']} lines", "", f"Quality Signal: {int(h['quality_signal'] * 10000)}/10000", f"Bottleneck: {h['bottleneck']}",
        f"Import edges: {a.import_edges.count()}, call edges: {a.call_edges.count()}, inherit edges: {a.inherit_edges.count()}",
        f"Functions: {h['total_functions']} (dead: {h['dead_functions']}, duplicated: {h['duplicate_functions']})", "", "Root Causes:",
        f"  Modularity:  {h['modularity']:.3f} (raw Q={h['q']:.3f})", f"  Acyclicity:  {h['acyclicity']:.3f} (cycles={h['cycles']})",
        f"  Depth:       {h['depth']:.3f} (max={h['max_depth']})", f"  Equality:    {h['equality']:.3f} (gini={h['gini']:.3f})",
        f"  Redundancy:  {h['redundancy']:.3f} (ratio={h['ratio']:.3f})",
    ]
    out += [f"Longest path: {' -> '.join(a.depth_path)}"] * bool(a.depth_path)
    out += ["Function hotspots:"] * bool(a.hotspots) + ["  {file}:{name} lines={lines} cyclomatic={cyclomatic} cognitive={cognitive}".format(**s) for s in a.hotspots]
    out += ["Skipped files:"] * bool(a.skipped) + [f"  {p}: {r}" for p, r in a.skipped]
    return "\n".join(out)


def config(root: str, name: str, missing: str) -> str:
    """The text of a file of the configuration folder."""
    path = os.path.join(root, CONFIG_DIR, name)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    if not os.path.exists(path):
        raise CommandError(missing)
    if os.path.getsize(path) > READ_BYTES:
        raise CommandError("FileTooLarge")
    with open(path, encoding="utf-8", errors="surrogateescape") as f:
        return f.read()


def baseline_of(a: Analysis) -> Baseline:
    h = a.health
    return Baseline(1, h["quality_signal"], h["cycle_count"], h["max_depth"], h["total_functions"], h["dead_functions"], h["duplicate_functions"])


def gate_metrics(b: Baseline) -> dict:
    return {
        "quality_signal": score_int(b.quality_signal), "cycle_count": b.cycle_count, "max_depth": b.max_depth,
        "total_functions": b.total_functions, "dead_functions": b.dead_functions, "duplicate_functions": b.duplicate_functions,
    }


def check_tree(spark: SparkSession, root: str, aliases: bool = False) -> tuple[Analysis, Rules, list]:
    """The rules are read before the tree, so that a bad file fails at once."""
    rules = parse_rules(config(root, "rules.toml", "NoRulesFile"))
    a = analyze(spark, root, manifests=aliases)
    edges = a.import_edges.selectExpr("from_file AS `from`", "to_file AS `to`")
    return a, rules, R.check(rules, a.health_row(), a.functions, edges, a.paths).collect()


def gate_tree(spark: SparkSession, root: str, aliases: bool = False) -> tuple[Analysis, Baseline, Baseline, list[str]]:
    before = loads(config(root, "baseline.json", "NoBaseline"))
    a = analyze(spark, root, manifests=aliases)
    now = baseline_of(a).validate()
    rows = R.regressions(*(spark.createDataFrame([b.__dict__]) for b in (before, now)))
    return a, before, now, [r["message"] for r in rows.collect()]


def run(spark: SparkSession, o: Options) -> tuple[dict, str, int]:
    """(JSON output, text output, exit code) of a command."""
    if o.command == "scan":
        a = analyze(spark, o.path, manifests=o.aliases)
        return scan_json(o.path, a), scan_text(a), 0
    if o.command == "check":
        a, rules, found = check_tree(spark, o.path, o.aliases)
        n = R.rules_checked(rules)
        shown = [{"rule": v["rule"], "severity": v["severity"], "message": v["message"], "from": (v["files"] or [None])[0], "to": v["files"][1] if len(v["files"]) > 1 else None, "subject": v["subject"], "line": v["line"]} for v in found]
        quality = int(a.health["quality_signal"] * 10000)
        out = envelope(not found, o.path) | {"pass": not found, "rules_checked": n, "quality_signal": quality, "violations": shown}
        lines = [f"{n} rules checked", f"Quality: {quality}/10000"] + (["All rules passed"] if not found else [])
        for v in found:
            lines += [f"x [{v['severity']}] {v['rule']}: {v['message']}"] + [f"    {' -> '.join(v['files'])}"] * (len(v["files"]) > 1)
        lines += ["", f"{len(found)} violation(s)"] * bool(found)
        return out, "\n".join(lines), int(bool(found))
    place = os.path.join(o.path, CONFIG_DIR, "baseline.json")
    if o.save:
        a = analyze(spark, o.path, manifests=o.aliases)
        save(baseline_of(a), place)
        quality = int(a.health["quality_signal"] * 10000)
        out = envelope(True, o.path) | {"saved": True, "quality_signal": quality, "metrics": gate_metrics(baseline_of(a))}
        return out, f"Baseline saved\nQuality: {quality}/10000\nBaseline written to {place}", 0
    a, before, now, found = gate_tree(spark, o.path, o.aliases)
    out = envelope(not found, o.path) | {"pass": not found, "quality_signal": int(now.quality_signal * 10000), "baseline": gate_metrics(before), "current": gate_metrics(now), "violations": found}
    lines = ["Structural regression check", f"Quality:  {int(before.quality_signal * 10000)} -> {int(now.quality_signal * 10000)} (per 10000)", f"Cycles:  {before.cycle_count} -> {now.cycle_count}", f"Depth:   {before.max_depth} -> {now.max_depth}"]
    lines += [f"x {m}" for m in found] + ["", f"DEGRADED: {len(found)} regression(s)"] if found else ["No degradation detected"]
    return out, "\n".join(lines), int(bool(found))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    before = args[: args.index("--")] if "--" in args else args
    as_json = "--json" in before[1:]
    try:
        if not args:
            print(USAGE)
            return 2
        if args[0] in ("--help", "-h", "--version", "-v"):
            if len(args) > 1:
                raise CommandError("ExtraArgument")
            print(USAGE if args[0] in ("--help", "-h") else f"codehealth {TOOL_VERSION}")
            return 0
        options = parse_options(args[0], args[1:])
        spark = spark or SparkSession.builder.appName("codehealth").getOrCreate()
        out, text, status = run(spark, options)
        print(json.dumps(out, indent=2, ensure_ascii=False)) if options.json else print(text, file=sys.stderr)
        return status
    except Exception as error:
        code = code_of(error)
        if as_json:
            info = {"code": code, "category": category(code), "message": code}
            print(json.dumps({"schema_version": SCHEMA_VERSION, "tool_version": TOOL_VERSION, "ok": False, "error_info": info}, indent=2))
        else:
            print(f"codehealth: {code}", file=sys.stderr)
        return getattr(error, "status", 2)
