"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import cut

ROUNDS = 60
#: Edges of one partition, about: rounds on few edges take few tasks and files.
PART_EDGES = 100_000


def star(edges: DataFrame, small: bool, parts: int) -> DataFrame:
    """Hang each vertex's larger (or, if ``small``, smaller) neighbours and, if ``small``, itself on its least neighbour.

    Neither step needs a vertex's neighbours together: the least one is a partial
    aggregate, and joining it back is an ordinary equi-join, whose skew Spark splits.
    """
    if small:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sided = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sided.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").coalesce(parts).distinct().coalesce(parts)


def connected(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (u, v: two longs); the root is the component's smallest vertex, itself included.

    Null ends and loops are ignored. Each round is written to the shared folder, so the
    plan stays short and a lost executor loses no round.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = 1 + now.count() // PART_EDGES
    now, state = now.coalesce(parts), None
    for _ in range(ROUNDS):
        now = cut(star(star(now, False, parts), True, parts))
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: every vertex but the root hangs on the root.
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
