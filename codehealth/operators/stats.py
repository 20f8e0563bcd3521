"""Inequality, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR = 0.01
#: The scores in the order in which the first of equal ones is the bottleneck.
CAUSES = ("modularity", "acyclicity", "depth", "equality", "redundancy")


def gini(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, gini): the Gini coefficient of ``value``, 0 for one value or a sum of 0; no row for no value.

    Sums over distinct values with their counts, so no group is sorted row by row.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("last", F.sum("c").over(window))
    # The ranks of c equal values sum to c * (first + last) / 2.
    rank_sum = F.col("c") * (2 * F.col("last") - F.col("c") + 1) / 2
    sums = upto.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("total"), F.sum(rank_sum * F.col("x")).alias("ranked"))
    raw = (2 * F.col("ranked") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))
    clear = F.when((F.col("n") <= 1) | (F.col("total") == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return sums.where("n IS NOT NULL").select(*by, clear.alias("gini"))


def inequality(functions: DataFrame, files: DataFrame) -> float:
    """The Gini coefficient of the functions' ``cyclomatic``; without functions that of the files' ``lines``, without files 0."""
    found = gini(functions.select("cyclomatic"), "cyclomatic").first() or gini(files, "lines").first()
    return found["gini"] if found else 0.0


def score_columns(q: Column, cycles: Column, depth: Column, gini_: Column, ratio: Column) -> dict[str, Column]:
    """Each raw measure as a score from 0 to 1."""
    return {
        "modularity": (q + 0.5) / 1.5,
        "acyclicity": 1 / (1 + cycles.cast("double")),
        "depth": 1 / (1 + depth.cast("double") / 8),
        "equality": 1 - gini_,
        "redundancy": 1 - ratio,
    }


def scored(raw: DataFrame) -> DataFrame:
    """``raw`` (q, cycles, max_depth, gini, ratio) with the five scores, quality_signal and bottleneck."""
    scores = score_columns(*map(F.col, ("q", "cycles", "max_depth", "gini", "ratio")))
    out = raw.withColumns(scores)
    product = F.lit(1.0)
    for c in CAUSES:
        product = product * F.greatest(F.lit(FLOOR), F.col(c))
    least = F.array_min(F.array(*[F.struct(F.col(c).alias("s"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(CAUSES)]))
    return out.withColumn("quality_signal", F.pow(product, 0.2)).withColumn("bottleneck", least["name"])


def score_int(score: Column) -> Column:
    """A score in ten-thousandths, cut off, not rounded."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 10000).cast("int")


def hotspots(functions: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """The ``k`` functions of highest score: by cyclomatic, then cognitive complexity, then lines; ties by ``order``."""
    score = F.col("cyclomatic").cast("long") * 1_000_000 + F.col("cognitive").cast("long") * 1_000 + F.col("line_count")
    return functions.withColumn("score", score).orderBy(F.col("score").desc(), *order).limit(k)
