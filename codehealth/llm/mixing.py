"""Mixing sources to target weights by entropy balancing.

Among all rates that meet the token targets, the balanced ones are closest in relative
entropy to taking every token once. Their convex dual has one multiplier for each
constraint value, a document's rate is the exponential of the sum of its multipliers (at
most ``cap``), and damped Newton steps find them. Each step's gradient and Hessian are
sums over the constraint values' token counts, aggregated by Spark. Rates are
rounded to whole copies with the rounding error handed on from document to document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codehealth.llm.common import cut, unused

#: Fixed by the query's contract.
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Most constraint values whose multipliers the driver holds: sources are a catalogue, not data.
MAX_VALUES = 200_000
#: Combinations of constraint values that one task handles.
CELLS = 20_000
#: Documents of one rounding chain, about.
CHAIN = 4096


def capped_shares(sizes: dict, weights: dict, cap: float = CAP) -> dict:
    """Targets that share the total size by weight, none above ``cap`` times its size, the excess shared again."""
    left, open_, out = float(sum(sizes.values())), set(sizes), dict.fromkeys(sizes, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        for s in over or open_:
            out[s] = float(cap * sizes[s]) if over else share[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def by_code_point(values: list) -> list:
    return sorted((v for v in values if v is not None)) + [v for v in values if v is None]


def balance(rows: DataFrame, columns: list[str], targets: list[dict], size: str = "size", cap: float = CAP, tolerance: float = 1e-9, steps: int = 80) -> list[dict]:
    """Multipliers by constraint column and value, for which sum(size * rate) meets each target.

    ``rows`` has ``size`` and the constraint columns; ``targets[k]`` maps each value of
    ``columns[k]`` to its tokens. Values of no size keep multiplier 0. Targets must agree
    with each other; those out of reach are met as closely as ``cap`` lets them be.
    """
    cells = cut(rows.groupBy(*columns).agg(F.sum(size).cast("double").alias("t")).where("t > 0"))
    cells = cells.coalesce(1 + cells.count() // CELLS)
    keys = [(k, v) for k, t in enumerate(targets) for v in t]
    if len(keys) > MAX_VALUES:
        raise ValueError(f"{len(keys)} constraint values; at most {MAX_VALUES} are supported")
    place = {key: i for i, key in enumerate(keys)}
    goal = np.array([targets[k][v] for k, v in keys], float)
    schema = rows.select(*columns).schema
    spark = rows.sparkSession

    def at(x: np.ndarray) -> tuple[float, np.ndarray, dict]:
        """The dual's value, its gradient and the Hessian's entries, by one aggregation over the cells."""
        df = cells
        for k, c in enumerate(columns):
            lam = spark.createDataFrame([(v, float(x[place[k, v]])) for v in targets[k]], f"v{k} {schema[c].dataType.simpleString()}, l{k} double")
            # At most MAX_VALUES rows.
            df = df.join(F.broadcast(lam), df[c].eqNullSafe(lam[f"v{k}"])).drop(f"v{k}")
        log = sum((F.col(f"l{k}") for k in range(len(columns))), F.lit(0.0))
        inside = F.exp(log)
        df = df.withColumn("log", log).withColumn("rate", F.least(inside, F.lit(float(cap))))
        df = df.withColumn("dual", F.when(F.col("log") <= float(np.log(cap)), inside).otherwise(cap * (1 + F.col("log") - float(np.log(cap)))))
        # A cell is one combination of constraint values already, so nothing is shuffled here.
        sums = df.select(
            *columns,
            (F.col("t") * F.col("rate")).alias("g"),
            # Also where the cap holds: a zero would leave multipliers that went too far where they are.
            (F.col("t") * F.col("rate")).alias("h"),
            (F.col("t") * F.col("dual")).alias("d"),
        )
        grad, hess, value = -goal.copy(), {}, -float(goal @ x)
        for row in sums.collect():
            at_ = [place[k, row[c]] for k, c in enumerate(columns)]
            value += row["d"]
            for i in at_:
                grad[i] += row["g"]
                for j in at_:
                    hess[i, j] = hess.get((i, j), 0.0) + row["h"]
        return value, grad, hess

    x = np.zeros(len(keys))
    value, grad, hess = at(x)
    for _ in range(steps):
        if np.abs(grad).max(initial=0.0) <= tolerance * max(1.0, goal.sum()):
            break
        if len(columns) == 1:
            diagonal = np.array([hess.get((i, i), 0.0) for i in range(len(keys))])
            step = np.divide(-grad, diagonal, out=np.zeros_like(grad), where=diagonal > 0)
        else:
            full = np.zeros((len(keys), len(keys)))
            for (i, j), v in hess.items():
                full[i, j] = v
            step = np.linalg.lstsq(full, -grad, rcond=1e-12)[0]
        step = np.clip(step, -2.0, 1.0)
        if len(columns) == 1:
            # Beyond the cap's logarithm nothing changes, so multipliers stop there.
            step = np.minimum(x + step, np.log(cap)) - x
        scale = 1.0
        while True:
            new = at(x + scale * step)
            # Close to the solution the value's rounding hides the descent, but the gradient still shrinks.
            if new[0] <= value + 1e-4 * scale * float(grad @ step) or np.abs(new[1]).max() <= 0.5 * np.abs(grad).max() or scale < 1e-6:
                break
            scale /= 2
        done = np.abs(new[1]).max() >= np.abs(grad).max() and scale < 1e-6
        x = x + scale * step
        value, grad, hess = new
        if done:
            break
    return [{v: float(x[place[k, v]]) for v in t} for k, t in enumerate(targets)]


def copies(rows: DataFrame, chain: list[str], cap: int = CAP) -> DataFrame:
    """``rows`` (id, size, rate and more) with whole ``copies``, at most ``cap``, whose words keep near the rates'.

    Rows of equal ``chain`` columns are rounded one after the other, largest first; each
    hands the words it took too few or too many to the next.
    """
    names = rows.columns
    dealt = rows.repartition(*chain).sortWithinPartitions(*chain, F.col("size").desc(), F.col("id"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owed = None, 0.0
        for batch in batches:
            cols = [batch.column(names.index(c)).to_pylist() for c in [*chain, "size", "rate"]]
            out = []
            for *k, size, rate in zip(*cols):
                if k != key:
                    key, owed = k, 0.0
                if size:
                    want = rate * size + owed
                    n = min(cap, max(0, int(want / size + 0.5)))
                    owed = want - n * size
                else:
                    n = min(cap, int(rate + 0.5))
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "copies"])

    return dealt.mapInArrow(run, schema)


def words_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def planned(rows: DataFrame, weights: tuple, cap: int) -> DataFrame:
    """(s, source_size, target, rate, chains) of each source of ``rows`` (source, size, n), ``n`` documents each."""
    rows = cut(rows.groupBy("source", "size").agg(F.sum("n").alias("n")))
    stats = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    found = {r["source"]: (r["source_size"], r["n"]) for r in stats.limit(MAX_VALUES + 1).collect()}
    if len(found) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} sources are not supported")
    order = by_code_point(list(found))
    sizes = {s: found[s][0] for s in order}
    targets = capped_shares(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, cap)
    lam = balance(rows.withColumn("size", F.col("size") * F.col("n")), ["source"], [targets], cap=cap)[0]
    plan = [(s, sizes[s], targets[s], float(min(cap, np.exp(lam[s]))) if sizes[s] else 1.0, -(-found[s][1] // CHAIN)) for s in order]
    return rows.sparkSession.createDataFrame(plan, f"s {rows.schema['source'].dataType.simpleString()}, source_size long, target double, rate double, chains long")


def chained(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (id, source) with their source's plan and the number of their rounding chain."""
    # At most MAX_VALUES rows; dealing the rows by source instead would bring a hot source to one task.
    joined = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["s"]), "left").drop("s")
    return joined.withColumn("chain", F.pmod(F.xxhash64("id"), F.col("chains"))).drop("chains")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies, rate.

    Sizes count runs of non-white-space (null text: 0). Sources by code point, null last,
    get ``weights`` in turn. Documents without words get copies but take no words; an
    empty table gives an empty result; repeated rows count as often as they occur; other
    columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(text_col).alias("size")))
    joined = chained(rows, planned(rows.withColumn("n", F.lit(1).cast("long")), weights, cap))
    return copies(joined, ["source", "chain"], cap).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )


def mixed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` that the mix takes at least once, with ``mix_copies`` and ``mix_taken`` (with underscores before, if ``docs`` has them).

    Texts stay out of the rounding chains: a hash stands for them there, and the rows
    taken are found again by id, source and hash. Rows that are equal in these are taken
    equally often.
    """
    names = [unused(docs.columns, n) for n in ("mix_copies", "mix_taken")]
    own = unused(docs.columns, "__key")
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    rows = cut(docs.select(key.alias("id"), words_of(text_col).alias("words")).groupBy("id").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n")))
    rows = rows.withColumn("source", F.col("id.source"))
    plan = planned(rows.select("source", F.col("words").alias("size"), "n"), weights, cap)
    found = copies(chained(rows.withColumn("size", F.col("words") * F.col("n")), plan), ["source", "chain"], cap).where("copies > 0")
    taken = found.select(F.col("id").alias(f"{own}_taken"), F.col("copies").alias(names[0]), (F.col("words") * F.col("copies")).alias(names[1]))
    same = [F.col(f"{own}.{c}").eqNullSafe(F.col(f"{own}_taken.{c}")) for c in ("id", "source", "hash")]
    # The join is the same at every size.
    joined = docs.withColumn(own, key).join(taken.hint("merge"), same)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *names)
