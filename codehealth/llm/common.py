"""What the operators of this package share: table access, the shared folder and words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.session import cut, new_dir

__all__ = ["Hashes", "cut", "join_groups", "likely_in", "maybe_in", "mixed", "new_dir", "pieces", "saved", "shingles", "table", "unused", "utf8", "without", "word_hashes", "words"]

#: A-Z become a-z; every ASCII byte that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_CACHE = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as it is among ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(text: str = "text"):
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def words(data: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes."""
    return data.translate(WORD_BYTES).split()


class Hashes(dict):
    """64-bit hash by word, kept for the words seen; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in text order; a text of fewer words has one run, its whole."""
    size = len(hashes)
    if size == 0:
        return hashes
    n = min(n, size)
    out = np.full(size - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : size - n + 1 + k])
    return out


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder as compressed columns, and read again."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits of a filter: what is broadcast is at most so many rows, whatever the number of keys.
FILTER_WORDS = 1 << 20


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, flag: str = "__maybe") -> DataFrame:
    """``rows`` with ``flag``: false only if ``key`` is surely not among ``keys`` (one column), by a bitmap of fixed size."""
    (name,) = keys.columns
    word, bits = unused(rows.columns, "__word"), unused(rows.columns, "__bits")
    own, place = (F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(FILTER_WORDS * 64)) for c in (name, key))
    one = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{name}`), 64) AS INT))")
    words = keys.select((own / 64).cast("long").alias(word), one.alias("one")).groupBy(word).agg(F.bit_or("one").alias(bits))
    found = rows.join(F.broadcast(words), (place / 64).cast("long") == F.col(word), "left")
    hit = F.coalesce(F.getbit(bits, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(64)).cast("int")) == 1, F.lit(False))
    return found.withColumn(flag, hit).drop(word, bits)


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among ``keys``: what is left to an exact join."""
    flag = unused(rows.columns, "__maybe")
    return maybe_in(rows, key, keys, flag).where(f"`{flag}`").drop(flag)


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` isn't among ``keys`` (one column, computed); only rows that may have to go are moved."""
    own, flag = unused(rows.columns, "__key"), unused(rows.columns, "__maybe")
    (name,) = keys.columns
    gone = keys.select(F.col(name).alias(f"{own}_gone"))
    marked = maybe_in(rows.withColumn(own, key), own, gone, flag)
    moved = marked.where(f"`{flag}`").join(gone, F.col(own) == F.col(f"{own}_gone"), "left_anti")
    return marked.where(f"NOT `{flag}`").select(rows.columns).unionAll(moved.select(rows.columns))


#: Groups of more than a HOT_GROUPS-th of all rows, of which there are fewer than that, have their rows dealt to SALTS places.
HOT_GROUPS, SALTS = 1000, 32


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to ``groups`` on ``key``, where ``size`` rows have a group's key; a group may hold most of them."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > F.lit(total / HOT_GROUPS)
    # Fewer than HOT_GROUPS rows.
    hot = F.broadcast(groups.where(large).select(F.col(key).alias("__hot")))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]), F.lit(SALTS)).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(0)).drop("__hot")
    places = F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn("__salt", F.explode(places)), [key, "__salt"]).drop("__salt")


PIECE = 1 << 20


def pieces(data: bytes) -> list[bytes]:
    """The text's word bytes in runs of about a megabyte that end between words, so that very long texts need little memory."""
    clean = data.translate(WORD_BYTES)
    out, at = [], 0
    while len(clean) - at > PIECE:
        end = clean.find(b" ", at + PIECE)
        if end < 0:
            break
        out.append(clean[at:end])
        at = end
    return [*out, clean[at:]] if at else [clean]


def word_hashes(data: bytes, cache: Hashes) -> np.ndarray:
    """The hash of each word, in text order."""
    found = [cache.of(p.split()) for p in pieces(data)]
    return found[0] if len(found) == 1 else np.concatenate(found)
