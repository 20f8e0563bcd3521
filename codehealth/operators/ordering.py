"""Numbering rows in a global order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehealth.session import cut

#: Bits of a row's number within its partition in ``monotonically_increasing_id``.
ROW_BITS = 33


def placed(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 on in ``order``: sorted by ranges, each range's places following the ones before it."""
    marked = cut(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", ROW_BITS)
    sizes = sorted(marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part_, n in sizes:
        before.append((part_, total))
        total += n
    # One row for each partition.
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    found = marked.join(starts, part == F.col("__part"))
    return found.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1) + 1).drop("__at", "__part", "__before")
