"""Rule checks and the regression gate, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.functions.globs import glob_regex
from codehealth.sources.rulefile import Boundary, Layer, Rules, check_rules

VIOLATION = "rule string, severity string, message string, files array<string>, subject string, line int"
#: Column and label of what each floor limits.
FLOORS = {
    "min_quality": ("quality_signal", "quality"),
    "min_modularity": ("modularity", "modularity"),
    "min_acyclicity": ("acyclicity", "acyclicity"),
    "min_depth": ("depth", "depth score"),
    "min_equality": ("equality", "equality"),
    "min_redundancy": ("redundancy", "redundancy"),
}
TOTALS = {
    "max_cycles": ("cycle_count", "%d cycles > allowed %d"),
    "max_file_lines": ("max_file_lines", "largest file has %d lines > allowed %d"),
    "max_fn_lines": ("max_fn_lines", "largest function has %d lines > allowed %d"),
}
COMPLEXITIES = {"max_cyclomatic": ("cyclomatic", "cyclomatic complexity"), "max_cognitive": ("cognitive", "cognitive complexity")}
#: How far the quality signal may fall.
TOLERANCE = 0.02
INPUT_PATH = r"^(?![/\\])(?![A-Za-z]:)(?!(?:.*/)?(?:\.|\.\.)?(?:/|$))[^\\]+$"


class AmbiguousLayer(ValueError):
    """A path that is in more than one layer."""


class BadInput(ValueError):
    """A path that isn't relative, clean and with slashes."""


def violation(rule: str | Column, message: Column, files: Column | None = None, subject: Column | None = None, line: Column | None = None) -> list[Column]:
    return [
        (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"),
        F.lit("Error").alias("severity"),
        message.alias("message"),
        (files if files is not None else F.array().cast("array<string>")).alias("files"),
        (subject if subject is not None else F.lit(None).cast("string")).alias("subject"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"),
    ]


def score_floors(health: DataFrame, floors: dict[str, float]) -> DataFrame:
    """A violation for each score of the one row of ``health`` that is below its floor."""
    rows = [
        F.struct(
            F.lit(key).alias("key"), F.lit(label).alias("label"), F.col(column).alias("seen"), F.lit(float(floors[key])).alias("least"),
            (F.format_string(" (%d cycles)", F.col("cycle_count")) if key == "min_acyclicity" else F.lit("")).alias("more"),
        )
        for key, (column, label) in FLOORS.items()
        if key in floors
    ]
    if not rows:
        return health.sparkSession.createDataFrame([], VIOLATION)
    low = health.select(F.explode(F.array(*rows)).alias("f")).select("f.*").where("seen < least")
    text = F.concat(F.format_string("%s %.3f < required %.3f", "label", "seen", "least"), F.col("more"))
    return low.select(*violation(F.col("key"), text))


def ceilings(health: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A violation for each total of the one row of ``health`` that is above its ceiling."""
    out = health.sparkSession.createDataFrame([], VIOLATION)
    for key, (column, text) in TOTALS.items():
        if key in limits:
            over = health.where(F.col(column) > limits[key])
            out = out.unionAll(over.select(*violation(key, F.format_string(text, column, F.lit(limits[key])))))
    return out


def complexity_ceilings(functions: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A violation for each of ``functions`` (file, name, start_line, cyclomatic, cognitive) above a ceiling."""
    out = functions.sparkSession.createDataFrame([], VIOLATION)
    for key, (column, label) in COMPLEXITIES.items():
        if key in limits:
            over = functions.where(F.col(column) > limits[key])
            text = F.format_string(f"%s:%d: %s has {label} %d > allowed %d", "file", "start_line", "name", column, F.lit(limits[key]))
            out = out.unionAll(over.select(*violation(key, text, F.array("file"), F.col("name"), F.col("start_line"))))
    return out


def layers_of(paths: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    """(path, layer, layer_order, n): by path the layer whose globs match, and how many do."""
    hits = [F.when(F.col("path").rlike(glob_regex(p)), F.struct(F.lit(k).alias("k"), F.lit(layer.name).alias("layer"), F.lit(layer.order).cast("long").alias("layer_order"))) for k, layer in enumerate(layers) for p in layer.paths]
    hit = paths.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*hits))).alias("l")).select("path", "l.*")
    return hit.groupBy("path").agg(F.min_by("layer", "k").alias("layer"), F.min_by("layer_order", "k").alias("layer_order"), F.count_distinct("k").alias("n"))


def layer_violations(edges: DataFrame, paths: DataFrame, layers: tuple[Layer, ...]) -> DataFrame:
    """A violation for each of ``edges`` (from, to) into a layer of lower order; AmbiguousLayer if a path has two layers."""
    if not layers:
        return edges.sparkSession.createDataFrame([], VIOLATION)
    homes = layers_of(paths.unionAll(edges.select(F.col("from").alias("path"))).unionAll(edges.select(F.col("to").alias("path"))), layers)
    double = homes.where("n > 1").select("path").first()
    if double is not None:
        raise AmbiguousLayer(double["path"])
    if len(layers) < 2:
        return edges.sparkSession.createDataFrame([], VIOLATION)
    a = homes.select(F.col("path").alias("from"), F.col("layer").alias("a"), F.col("layer_order").alias("a_order"))
    b = homes.select(F.col("path").alias("to"), F.col("layer").alias("b"), F.col("layer_order").alias("b_order"))
    down = edges.join(a, "from").join(b, "to").where("a_order > b_order")
    text = F.format_string("layer '%s' (order %d) imports '%s' (order %d)", "a", "a_order", "b", "b_order")
    return down.select(*violation("layer_order", text, F.array("from", "to")))


def boundary_violations(edges: DataFrame, boundaries: tuple[Boundary, ...]) -> DataFrame:
    """A violation for each of ``edges`` (from, to) and boundary whose globs match both ends."""
    if not boundaries:
        return edges.sparkSession.createDataFrame([], VIOLATION)
    hits = [F.when(F.col("from").rlike(glob_regex(b.source)) & F.col("to").rlike(glob_regex(b.target)), F.lit(f" — {b.reason}" if b.reason else "")) for b in boundaries]
    hit = edges.select("from", "to", F.explode(F.array_compact(F.array(*hits))).alias("why"))
    return hit.select(*violation("boundary", F.format_string("%s must not import %s%s", "from", "to", "why"), F.array("from", "to")))


def ordered(violations: DataFrame) -> DataFrame:
    """Each violation once, by rule, files, line and message."""
    once = violations.dropDuplicates(["rule", "message", "files", "subject"])
    first, second = (F.coalesce(F.get("files", F.lit(k)), F.lit("")) for k in (0, 1))
    return once.orderBy("rule", first, second, F.coalesce("line", F.lit(0)), "message")


def rules_checked(rules: Rules) -> int:
    """One for each floor and ceiling, one for two layers or more, one for each boundary."""
    return len(rules.floors) + len(rules.ceilings) + (len(rules.layers) >= 2) + len(rules.boundaries)


def bad_paths(paths: DataFrame) -> DataFrame:
    """The paths that the rules can't be held against."""
    return paths.where(~F.coalesce(F.col("path").rlike(INPUT_PATH), F.lit(False)))


def check(rules: Rules, health: DataFrame, functions: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """All violations in order. ``edges``: from, to; ``paths``: path."""
    check_rules(rules)
    every = paths.select("path").unionAll(edges.select("from")).unionAll(edges.select("to")).unionAll(functions.select("file"))
    wrong = bad_paths(every).first()
    if wrong is not None:
        raise BadInput(wrong["path"])
    found = score_floors(health, rules.floors).unionAll(ceilings(health, rules.ceilings)).unionAll(complexity_ceilings(functions, rules.ceilings))
    found = found.unionAll(layer_violations(edges, paths, rules.layers)).unionAll(boundary_violations(edges, rules.boundaries))
    return ordered(found)


GATE = (
    ("cycle_count", "Cycle count increased"),
    ("max_depth", "Max depth increased"),
    ("dead_functions", "Dead functions increased"),
    ("duplicate_functions", "Duplicated functions increased"),
)


def regressions(before: DataFrame, now: DataFrame) -> DataFrame:
    """(place, message): what got worse between two one-row tables of the baseline's columns."""
    both = before.select(F.struct(*before.columns).alias("b")).join(now.select(F.struct(*now.columns).alias("n")), F.lit(True))
    fell = F.col("n.quality_signal") < F.col("b.quality_signal") - TOLERANCE
    rows = [F.struct(F.lit(0).alias("place"), fell.alias("worse"), F.format_string("Quality signal dropped: %.3f -> %.3f", "b.quality_signal", "n.quality_signal").alias("message"))]
    for k, (column, text) in enumerate(GATE, 1):
        rows.append(F.struct(F.lit(k).alias("place"), (F.col(f"n.{column}") > F.col(f"b.{column}")).alias("worse"), F.format_string(f"{text}: %d -> %d", f"b.{column}", f"n.{column}").alias("message")))
    return both.select(F.explode(F.array(*rows)).alias("r")).where("r.worse").select("r.place", "r.message").orderBy("place")
