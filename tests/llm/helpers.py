"""Small inputs that the operators' tests share."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """A documents table of (doc_id, text) or whole rows."""
    full = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng: random.Random, n: int, words: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau") -> str:
    pool = words.split()
    return " ".join(rng.choice(pool) + str(rng.randrange(50)) for _ in range(n))


def with_clashes(df, *names):
    """``df`` with further columns of the given names, which an operator may use itself."""
    from pyspark.sql import functions as F

    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
