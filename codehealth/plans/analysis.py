"""The analysis of a source tree: tables, graphs, measures and the health report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.functions import paths as P
from codehealth.operators import deadcode, graph, links, resolve, stage, stats
from codehealth.session import cut
from codehealth.sources.manifests import aliases as manifest_aliases
from codehealth.sources.tree import read_tree


@dataclass
class Analysis:
    """Tables and figures of one tree."""

    health: dict
    functions: DataFrame
    import_edges: DataFrame
    call_edges: DataFrame
    inherit_edges: DataFrame
    paths: DataFrame
    depth_path: list[str]
    hotspots: list[dict]
    skipped: list[tuple[str, str]]

    def health_row(self) -> DataFrame:
        return self.paths.sparkSession.createDataFrame([self.health])


def flagged_functions(found: DataFrame, functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """``functions`` with ``dead`` and ``duplicate``."""
    mentions = stage.flat(found, "mentions").drop("file_ord")
    lively = deadcode.liveness(functions, mentions, call_edges, stage.local_calls(found))
    only_tests = deadcode.test_only(functions.where("production AND NOT public AND NOT method"), mentions)
    bodies = stage.bodies(found).join(only_tests, "fn", "left_anti")
    twice = deadcode.duplicates(bodies, ["file_ord", "fn_ord"]).where("duplicate").select("fn", "duplicate")
    return lively.join(twice, "fn", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def analyze(spark: SparkSession, root: str, aliases: dict[str, str] | None = None, manifests: bool = False, limit: int = links.CALLS_PER_CALLER, strict: bool = True, **options) -> Analysis:
    """Reads the tree below ``root`` and measures it.

    ``aliases``: root files by package name, for imports of packages of the tree.
    ``manifests``: whether the tree's own manifests add to these. ``limit``: call sites that count for each caller. ``strict``: see ``extract.functions``.
    """
    tree = cut(read_tree(spark, root, manifests=manifests, **options))
    if manifests:
        aliases = manifest_aliases(tree) | (aliases or {})
    found = cut(stage.staged(tree, aliases, strict))
    skips = tree.where("skipped IS NOT NULL").orderBy(F.col("skipped") != "file_too_large", "ord")
    files = found.select("path", "ord", "lines")
    functions = cut(stage.functions(found))
    imports = cut(resolve.import_edges(stage.imports(found), files))
    calls = cut(links.call_edges(stage.call_sites(found), functions.withColumn("place", F.col("fn")), imports, limit))
    classes = stage.flat(found, "classes").withColumn("seq", stage.function_id("cls_ord"))
    inherits = cut(links.inherit_edges(classes, imports))

    nodes = files.select(F.col("path").alias("id"), "ord", P.module_col(F.col("path")).alias("module"), P.is_entry_col(F.col("path")).alias("named"))
    import_graph = imports.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst"), "seq")
    edges = cut(graph.edge_bag(import_graph.select("src", "dst"), calls.select("from_file", "to_file"), inherits.select("child_file", "parent_file")))
    graph.checked(nodes, edges)
    sizes = graph.modularity(nodes, edges).first()
    cycles = graph.components(edges).select("scc").distinct().count()
    acyclic = cycles == 0 or graph.components(import_graph).isEmpty()
    depth, path = graph.longest_path(graph.entries(nodes, import_graph), import_graph, acyclic)

    gini = stats.inequality(functions, files)
    flagged = cut(flagged_functions(found, functions, calls))
    counts = deadcode.redundancy(flagged).first()
    totals = stage.totals(files).first()
    longest = functions.agg(F.coalesce(F.max("line_count"), F.lit(0))).first()[0]
    raw = {"q": sizes["q"], "cycles": cycles, "max_depth": depth, "gini": gini, "ratio": counts["ratio"]}
    health = stats.scored(spark.createDataFrame([raw], "q double, cycles long, max_depth long, gini double, ratio double")).first().asDict()
    health |= counts.asDict() | totals.asDict() | {"max_fn_lines": longest, "cycle_count": cycles, "edge_count": sizes["m"]}
    top = stats.hotspots(functions, ["file_ord", "fn_ord"]).select("file", "name", F.col("line_count").alias("lines"), "cyclomatic", "cognitive", "score")
    return Analysis(
        health, flagged, imports, calls, inherits, files.select("path"), path, [r.asDict() for r in top.collect()], [(r["path"], r["skipped"]) for r in skips.select("path", "skipped").toLocalIterator()]
    )
