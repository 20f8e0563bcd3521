"""Exact deduplication that compares full content and survives skew, in DataFrame operations only.

A text whose digest no other row has can't have a copy; it stays where it is. The others
are combined in three stages: Spark's partial aggregation drops copies inside each input
split, a salted aggregation merges copies within (digest, salt), and a last one merges
the salts' winners. Each stage groups by the digest and by the content itself, so two
different texts of one digest never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import SALTS, cut, join_groups, maybe_in, without


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def dedup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_of) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    ``digest`` maps a text column to a string column; it only deals rows out, so any
    function is right. Null text counts as empty. The largest id of a group stays; null
    ids lose against others and stay where a group has no other. Rows that repeat an id
    and its text are the same document and share ``kept``; ``group_size`` counts rows.
    Other columns of ``docs`` are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    several = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    marked = maybe_in(rows, "digest", several)
    alone = marked.where("NOT __maybe").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = marked.where("__maybe").drop("__maybe")
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    distinct = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    classes = cut(
        distinct.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    one = classes.where("contents = 1").select("digest", "keep_id", "group_size")
    found = alone.unionByName(join_groups(rows.select("id", "digest"), one, "digest", "group_size"))
    shared = classes.where("contents > 1").select("digest")
    if not shared.isEmpty():
        # Different texts share a digest: these rows are matched by their content as well.
        mixed = rows.join(shared, "digest", "left_semi")
        groups = (
            mixed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
            .groupBy("digest", "salt", "content")
            .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .groupBy("digest", "content")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        found = found.unionByName(mixed.join(groups, ["digest", "content"]).select("digest", "id", "keep_id", "group_size"))
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dedup_classes`` doesn't keep; all columns stay as they are."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    lost = dedup_classes(docs, id_col, text_col).where("not kept")
    lost = cut(lost.select(F.concat(name, F.lit(":"), "digest").alias("name")).distinct())
    return without(docs, F.concat(name, F.lit(":"), sha256_of(F.coalesce(F.col(text_col), F.lit("")))), lost)
