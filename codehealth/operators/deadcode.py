"""Unreachable and duplicated functions.

All edges between functions are known before the search begins, so reachability is one
breadth-first search from the functions that are live by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions import paths as P
from codehealth.operators.graph import reached

# Functions that a runtime calls.
RUNTIME_NAMES = ("main", "__main__")
PYTHON_NAMES = ("__init__", "__new__", "__del__", "__enter__", "__exit__", "__call__")
GO_NAMES = ("init",)
ENTRY_NAMES = ("index", "app", "build")


def is_root(file: Column, name: Column) -> Column:
    """Whether a runtime calls the function."""
    return (
        F.when(name.isin(*RUNTIME_NAMES), True)
        .when(file.endswith(".py"), name.isin(*PYTHON_NAMES))
        .when(file.endswith(".go"), name.isin(*GO_NAMES))
        .otherwise(P.is_entry_col(file) & name.isin(*ENTRY_NAMES))
    )


def usage(functions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, defining_files, defining_file, mentioning_files): where production files define a name, and how many mention it outside tests first.

    ``functions``: file, file_ord, name of production files; ``mentions``: file, name, first_in_test.
    """
    defined = functions.groupBy("name").agg(F.count_distinct("file").alias("defining_files"), F.min_by("file", "file_ord").alias("defining_file"))
    mentioned = mentions.where("NOT first_in_test").groupBy("name").agg(F.count(F.lit(1)).alias("mentioning_files"))
    joined = defined.join(mentioned, "name", "full")
    return joined.select("name", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("defining_files", "mentioning_files")], "defining_file")


def live_by_mention(functions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(fn) of functions that their own file mentions, or, if no other file defines the name, another file."""
    own = mentions.select("file", "name", F.lit(True).alias("mentioned"), "in_production")
    rows = functions.join(own, ["file", "name"], "left").join(usage(functions, mentions), "name", "left")
    elsewhere = F.col("mentioning_files") - F.coalesce(F.col("in_production"), F.lit(False)).cast("long")
    alone = (F.col("defining_files") == 1) & (F.col("defining_file") == F.col("file"))
    return rows.where(F.col("mentioned") | alone & (elsewhere > 0)).select("fn")


def function_edges(functions: DataFrame, call_edges: DataFrame, local_calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges src to dst, seeds): who makes whom live. ``functions``: fn, file, name, production; ``local_calls``: file, fn (caller or null), callee.

    A call to a name that the caller's file defines reaches those functions; one that the
    call graph resolved reaches what the graph says; any other call, and every call from
    outside a function, reaches all functions of the name.
    """
    every = functions.select("fn", "file", "name")
    production = functions.where("production").select("fn", "file", "name")
    kept = call_edges.where(~P.is_test_col(F.col("from_file")) & ~P.is_test_col(F.col("to_file")))
    by_graph = kept.join(production.select(F.col("fn").alias("src"), F.col("file").alias("from_file"), F.col("name").alias("from_func")), ["from_file", "from_func"])
    by_graph = by_graph.join(every.select(F.col("fn").alias("dst"), F.col("file").alias("to_file"), F.col("name").alias("to_func")), ["to_file", "to_func"]).select("src", "dst")

    called = local_calls.where("fn IS NOT NULL").select("fn", "callee").distinct().join(every.select("fn", "file", F.col("name").alias("caller")), "fn")
    own = every.select("file", F.col("name").alias("callee"), F.col("fn").alias("dst"))
    local = called.join(own, ["file", "callee"]).select(F.col("fn").alias("src"), "dst")
    foreign = called.join(own.select("file", "callee").distinct(), ["file", "callee"], "left_anti")
    graph = call_edges.select(F.col("from_file").alias("file"), F.col("from_func").alias("caller"), F.col("to_func").alias("callee")).distinct()
    guessed = foreign.join(graph, ["file", "caller", "callee"], "left_anti")
    named = every.select(F.col("name").alias("callee"), F.col("fn").alias("dst"))
    # All functions of a name stand behind one node, so that names with many calls and many functions stay small.
    to_name = guessed.select(F.col("fn").cast("string").alias("src"), F.concat(F.lit("name:"), "callee").alias("dst"))
    from_name = named.join(guessed.select("callee").distinct(), "callee").select(F.concat(F.lit("name:"), "callee").alias("src"), F.col("dst").cast("string").alias("dst"))
    direct = by_graph.unionAll(local).distinct().select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    top = local_calls.where("fn IS NULL").select("callee").distinct().join(named, "callee").select(F.col("dst").alias("fn")).distinct()
    return direct.unionAll(to_name).unionAll(from_name), top


def liveness(functions: DataFrame, mentions: DataFrame, call_edges: DataFrame, local_calls: DataFrame) -> DataFrame:
    """``functions`` (fn, file, file_ord, name, public, method, production) with ``root`` and ``dead``."""
    rooted = functions.withColumn("root", F.col("public") | F.col("method") | is_root(F.col("file"), F.col("name")))
    production = rooted.where("production")
    edges, top = function_edges(functions, call_edges, local_calls)
    seeds = production.where("root").select("fn").unionAll(live_by_mention(production, mentions)).unionAll(top)
    live = reached(seeds.select(F.col("fn").cast("string").alias("id")).distinct(), edges).withColumn("live", F.lit(True))
    joined = rooted.join(live, F.col("fn").cast("string") == F.col("id"), "left").drop("id")
    return joined.withColumn("dead", F.col("production") & ~F.col("root") & F.col("live").isNull()).drop("live")


def duplicates(bodies: DataFrame, order: list[str], key: str = "body") -> DataFrame:
    """``bodies`` with ``duplicate``: whether an earlier row has the same text."""
    window = Window.partitionBy(key).orderBy(*order)
    return bodies.withColumn("duplicate", F.row_number().over(window) > 1)


def test_only(functions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(fn) of functions that only test blocks of their file mention, and no production code anywhere."""
    own = mentions.where("in_test AND NOT in_production").select("file", "name")
    used = mentions.where("NOT first_in_test").select("name").distinct()
    return functions.join(own, ["file", "name"]).join(used, "name", "left_anti").select("fn")


def redundancy(flagged: DataFrame) -> DataFrame:
    """One row of counts and ratios of ``flagged`` (production, dead, duplicate); without production functions the ratio is 1."""
    counts = flagged.agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.count_if("production").alias("production_functions"),
        F.count_if("dead").alias("dead_functions"),
        F.count_if("duplicate").alias("duplicate_functions"),
        F.count_if(F.col("dead") | F.col("duplicate")).alias("redundant"),
    )
    none = F.col("production_functions") == 0

    def ratio(column: str, empty: float) -> Column:
        return F.when(none, F.lit(empty)).otherwise(F.col(column) / F.nullif("production_functions", F.lit(0)))

    return counts.select(
        "total_functions", "production_functions", "dead_functions", "duplicate_functions",
        ratio("dead_functions", 0.0).alias("dead_ratio"), ratio("duplicate_functions", 0.0).alias("duplication_ratio"), ratio("redundant", 1.0).alias("ratio"),
    )
