"""Call and inheritance edges: names joined to their definitions by decreasing confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.operators.resolve import first_seen

#: Call sites of one caller name in one file that are looked at.
CALLS_PER_CALLER = 20


def within_budget(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; all rows for a limit of 0."""
    if limit <= 0:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")


def ranked_targets(sites: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """``sites`` (site, from_file, callee, qualified) with ``to_file``, for those that resolve.

    Of the definitions in imported files the first public one counts, else the last. An
    unqualified name that nothing imported defines resolves if exactly one definition of
    it is public. ``functions``: file, name, public, place; ``imports``: from_file, to_file.
    """
    local = functions.select(F.col("file").alias("from_file"), F.col("name").alias("callee")).distinct()
    foreign = sites.join(local, ["from_file", "callee"], "left_anti")
    known = functions.select(F.col("file").alias("to_file"), F.col("name").alias("callee"), "public", "place")
    imported = foreign.join(imports.select("from_file", "to_file").distinct(), "from_file").join(known, ["to_file", "callee"])
    imported = imported.groupBy("site").agg(
        F.min_by("to_file", F.when(F.col("public"), F.col("place"))).alias("public_file"), F.max_by("to_file", "place").alias("last_file")
    )
    imported = imported.select("site", F.coalesce("public_file", "last_file").alias("imported_file"))
    sole = known.where("public").groupBy("callee").agg(F.count(F.lit(1)).alias("n"), F.min("to_file").alias("sole_file")).where("n = 1").drop("n")
    found = foreign.join(imported, "site", "left").join(sole, "callee", "left")
    target = F.coalesce("imported_file", F.when(~F.col("qualified"), F.col("sole_file")))
    return found.withColumn("to_file", target).where("to_file IS NOT NULL").drop("imported_file", "sole_file")


def call_edges(sites: DataFrame, functions: DataFrame, imports: DataFrame, limit: int = CALLS_PER_CALLER) -> DataFrame:
    """(from_file, from_func, to_file, to_func, seq) of ``sites`` (from_file, from_func, seq, callee, qualified).

    Every site of a caller uses up its budget, resolved or not.
    """
    some = within_budget(sites, ["from_file", "from_func"], ["seq"], limit).withColumn("site", F.struct("from_file", "seq"))
    found = ranked_targets(some, functions, imports)
    found = found.select("from_file", "from_func", "to_file", F.col("callee").alias("to_func"), "seq")
    return first_seen(found, ["from_file", "from_func", "to_file", "to_func"])


def inherit_edges(classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(child_file, child_class, parent_file, parent_class, seq) of ``classes`` (file, file_ord, name, bases, seq).

    A child that imports anything finds its base in an imported file or nowhere; one that
    imports nothing finds it where only one file defines it. Its own file never counts.
    """
    defined = classes.groupBy("name", "file").agg(F.min("file_ord").alias("file_ord")).select(F.col("name").alias("base"), F.col("file").alias("parent_file"), "file_ord")
    wanted = classes.select(F.col("file").alias("child_file"), F.col("name").alias("child_class"), "seq", F.posexplode("bases").alias("place", "base"))
    wanted = wanted.withColumn("seq", F.struct("seq", "place"))
    sources = imports.select(F.col("from_file").alias("child_file")).distinct()
    listed = imports.select(F.col("from_file").alias("child_file"), F.col("to_file").alias("parent_file")).distinct()
    near = wanted.join(listed, "child_file").join(defined, ["parent_file", "base"]).where("child_file <> parent_file")
    near = near.groupBy("child_file", "child_class", "seq", "base").agg(F.min_by("parent_file", "file_ord").alias("parent_file"))
    lone = defined.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("parent_file").alias("parent_file")).where("n = 1").drop("n")
    far = wanted.join(sources, "child_file", "left_anti").join(lone, "base").where("child_file <> parent_file")
    columns = ["child_file", "child_class", "parent_file", F.col("base").alias("parent_class"), "seq"]
    return first_seen(near.select(*columns).unionAll(far.select(*columns)), ["child_file", "child_class", "parent_file", "parent_class"])


def enclosing(points: DataFrame, intervals: DataFrame, keys: list[str], smallest: bool) -> DataFrame:
    """``points`` (keys, point) with ``inside``: the place of the interval (keys, place, low, high) around each, null for none.

    The smallest interval counts, or the one of least place; equal sizes go by place. All
    ends are whole numbers. Each interval is taken apart into the largest aligned blocks
    that it covers, at most two of each power of two; a block keeps its best interval
    only, and each different point looks up the one block of each size that it is in.
    """
    low, high = F.col("low").cast("long"), F.col("high").cast("long")
    rank = F.struct((high - low).alias("size"), "place") if smallest else F.struct("place")
    # At level k, blocks of 2**k: from the first that begins inside to the last that ends inside.
    first, after = "(-shiftright(-__low, k))", "shiftright(__high + 1, k)"
    ends = f"array_compact(array(IF({first} < {after} AND {first} % 2 <> 0, {first}, NULL), IF({first} < {after} AND {after} % 2 <> 0, {after} - 1, NULL)))"
    rows = intervals.where(low <= high).select(*keys, low.alias("__low"), high.alias("__high"), rank.alias("__rank"))
    levels = F.expr("sequence(0, CAST(ceil(log2(__high - __low + 2)) AS INT))")
    blocks = rows.withColumn("k", F.explode(levels)).withColumn("__block", F.explode(F.expr(ends)))
    best = blocks.groupBy(*keys, "k", "__block").agg(F.min("__rank").alias("__best"))
    top = intervals.agg(F.max(F.ceil(F.log2(high - low + 2)))).first()[0]
    asked = points.select(*keys, F.col("point").cast("long").alias("__point")).distinct()
    asked = asked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(top or 0))))).withColumn("__block", F.expr("shiftright(__point, k)"))
    # Merged, as what looks small once compressed can be more than the driver holds to broadcast it.
    found = asked.join(best.hint("merge"), [*keys, "k", "__block"]).groupBy(*keys, "__point").agg(F.min("__best")["place"].alias("inside"))
    placed = points.withColumn("__point", F.col("point").cast("long")).join(found.hint("merge"), [*keys, "__point"], "left")
    return placed.select(*points.columns, "inside")


def overlapping(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``intervals`` (keys, place, low, high) with ``overlaps``: whether another one of the same keys shares a point with it.

    In order of their lower ends an interval meets an earlier one that reaches it, or the next one.
    """
    order = Window.partitionBy(*keys).orderBy("low", "place")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("low").over(order)
    return intervals.withColumn("overlaps", F.coalesce(reach >= F.col("low"), F.lit(False)) | F.coalesce(after <= F.col("high"), F.lit(False)))
