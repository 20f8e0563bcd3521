"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (one to three
letters, words padded with a blank), by rank. A document gets the language whose profile
is least out of place with its own: the sum of rank differences over the document's most
frequent n-grams, where an n-gram that the profile lacks costs the profile's length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codehealth.llm.common import unused

TOP = 300
#: Documents of each language that the profiles are learned from, at most.
TRAIN_DOCS = 1000
SALTS = 32
UNKNOWN = "und"
CHUNK = 1 << 20
BLANK = np.uint32(32)


@cache
def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order with their counts."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    if counts is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(counts, first)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams and how often each occurs; the whole text, in pieces of bounded size."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    tail = np.array([BLANK], np.uint32)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letters()[points], points, BLANK)
        if at + CHUNK >= len(text):
            points = np.append(points, BLANK)
        points = np.concatenate([tail[-1:], points])
        keep = (points[1:] != BLANK) | (points[:-1] != BLANK)
        new = points[1:][keep]
        a = np.concatenate([tail, new]).astype(np.int64)
        k = len(tail)
        one = a[k:][a[k:] != 32]
        two = (a[k - 1 : -1] << 21 | a[k:]) if len(new) else a[:0]
        x = a[max(0, k - 2) :]
        three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[x[1:-1] != 32] if len(x) > 2 else a[:0]
        parts.append(counted(np.concatenate([one, two, three])))
        tail = a[-2:].astype(np.uint32)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return counted(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first, of equal ones the smaller first."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """The learned languages, by code point of their names, and their profiles as one rank table."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.top, self.langs = top, sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked codes to each language, as a share of the largest possible."""
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        found = self.ranks[at]
        gap = np.where(found < 0, self.top, np.minimum(self.top, np.abs(found - np.arange(len(own))[:, None])))
        return gap.sum(0) / (self.top * len(own))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, lead of the best over the second best, best distance); ``und`` without a letter."""
        own = ranked(*ngrams(text), self.top) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0, 1.0
        d = self.distances(own)
        best = int(np.argmin(d))
        rest = np.delete(d, best).min(initial=1.0)
        return self.langs[best], float((rest - d[best]) / rest) if rest > 0 else 0.0, float(d[best])


def remainder(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, top: int = TOP) -> Profiles:
    """Profiles of the languages of ``docs``' rows with language and text; at most ``train_docs`` rows of each, by hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    # First within salts, so that no task ranks all rows of a frequent language.
    chosen = rows.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_docs).drop("k")
    chosen = chosen.select(F.col("id").alias("c_id"), F.col("lang").alias("c_lang")).distinct()
    some = rows.join(F.broadcast(chosen), rows["id"].eqNullSafe(chosen["c_id"]) & (rows["lang"] == chosen["c_lang"])).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[lang].append(ngrams(text))
            for lang, parts in found.items():
                codes, counts = counted(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    sums = some.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    profiles = defaultdict(list)
    for row in sums.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top).orderBy("lang", "k").toLocalIterator():
        profiles[row["lang"]].append(row["code"])
    return Profiles(dict(profiles), top)


def predicted(docs: DataFrame, profiles: Profiles, text_col: str = "text", new: tuple = ("lid_lang", "lid_score", "lid_distance")) -> DataFrame:
    """Every row of ``docs`` with the predicted language, its score and its distance in columns named ``new``.

    ``lid_lang`` is ``und`` where text is null or has no letter, or no language was
    learned; ties go to the language first by code point. ``lid_score`` is how far the
    second best language is behind (0 to 1), ``lid_distance`` the best distance (1: the
    profile has none of the document's n-grams). Other columns pass through.
    """
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *new])

    kinds = zip(new, (T.StringType(), T.DoubleType(), T.DoubleType()))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in kinds]]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, held: int = 1, **options) -> DataFrame:
    """id, held_out, lang_pred, score of every row, learned from rows whose id's remainder modulo ``parts`` isn't ``held``."""
    out = remainder(F.col(id_col), parts) == held
    profiles = learn(docs.where(~out), id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    found = predicted(rows, profiles)
    return found.select(F.col("id").alias(id_col), "held_out", F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, held: int = 1, **options) -> DataFrame:
    """``docs`` without the rows of no language: no letter, or no n-gram that any profile has."""
    profiles = learn(docs.where(remainder(F.col(id_col), parts) != held), id_col, text_col, lang_col, **options)
    new = tuple(unused(docs.columns, n) for n in ("lid_lang", "lid_score", "lid_distance"))
    found = predicted(docs, profiles, text_col, new)
    return found.where((F.col(new[0]) != UNKNOWN) & (F.col(new[2]) < 1)).select(docs.columns)
