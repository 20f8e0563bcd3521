"""Benchmark decontamination: test items inside documents, by MinHash containment and exact checks.

A document may hold a thousand times an item's shingles, so their Jaccard similarity
says nothing; containment does. Items are partitioned by size. Each partition has its
own MinHash sketch length (the item's shingles of smallest hash, of which a containing
document holds the item's containment share) and the number of hits that makes a
document a candidate, chosen so that a match is missed less often than ``MISS``. The
document's side is never sketched: its shingles stream past the sketches once. Each
candidate is verified by the exact share of the item's distinct shingles it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codehealth.llm.common import Hashes, cut, likely_in, mixed, shingles, utf8, without, word_hashes

WORDS, CONTAINED, MISS = 5, 0.8, 1e-9
#: Shingles of items that are broadcast to every task, at most: 8 bytes each.
BLOCK_SHINGLES = 2_000_000


def plan(size: int, contained: float, miss: float) -> tuple[int, int]:
    """(sketch length, hits that make a candidate) for items of at least ``size`` shingles, size a power of two.

    The most hits are asked for that a sketch of up to 32 lets reach the miss bound; items
    of fewer shingles than that are sketched whole, and one hit is enough.
    """
    best = (size if size < 16 else 16, 1)
    for k in (16, 24, 32):
        if k > size:
            break
        for hits in range(2, k // 2):
            missed = sum(comb(k, i) * contained**i * (1 - contained) ** (k - i) for i in range(hits))
            if missed <= miss and hits > best[1]:
                best = (k, hits)
    return best


class Items:
    """A block of items ready for search: sketches in one sorted array, full shingle sets beside them."""

    def __init__(self, items: list[tuple[int, bytes]], words: int, contained: float, miss: float):
        cache = Hashes()
        self.contained, self.need = contained, []
        self.ids, self.sets, self.runs = [], [], []
        keys, owners = [], []
        for id_, text in items:
            h = word_hashes(text, cache)
            if not len(h):
                continue
            run = min(words, len(h))
            own = np.unique(shingles(h, words))
            k, hits = plan(1 << (len(own).bit_length() - 1), contained, miss)
            sketch = own[np.argsort(mixed(own), kind="stable")[:k]]
            keys.append(sketch)
            owners.append(np.full(len(sketch), len(self.ids)))
            self.ids.append(id_)
            self.sets.append(own)
            self.runs.append(run)
            self.need.append(hits)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.need = np.array(self.need, np.int64)
        self.lengths = sorted(set(self.runs))
        #: Which low bits any key has: most shingles of a document fail this test at once.
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.keys & np.uint64((1 << 18) - 1)] = True

    def search(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(place of the item, its shingles, those that the document holds) of all items that the document contains."""
        out = []
        for run in self.lengths:
            if len(hashes) < run:
                continue
            have = shingles(hashes, run)
            hit = have[self.bits[have & np.uint64((1 << 18) - 1)]]
            if not len(hit):
                continue
            hit = np.unique(hit)
            lo, hi = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
            if not (hi > lo).any():
                continue
            owners = np.concatenate([self.owners[a:b] for a, b in zip(lo, hi) if b > a])
            which, hits = np.unique(owners, return_counts=True)
            have = None if not (hits >= self.need[which]).any() else np.unique(have)
            for i, n in zip(which.tolist(), hits.tolist()):
                if n >= self.need[i] and self.runs[i] == run:
                    at = np.searchsorted(have, self.sets[i])
                    shared = int((have[np.minimum(at, len(have) - 1)] == self.sets[i]).sum())
                    if shared >= self.contained * len(self.sets[i]):
                        out.append((i, len(self.sets[i]), shared))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, contained: float = CONTAINED, miss: float = MISS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs`` and row of ``items`` that it contains: id, item id, n_item, n_shared, containment.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters, shingles
    runs of ``words`` of them (an item of fewer words is one shingle). Containment is the
    share of the item's distinct shingles that the document holds; pairs from ``contained``
    up are returned. Null or wordless texts and items match nothing; repeated rows match
    repeatedly; other columns are ignored. Items of at most about ``block`` shingles are
    held by every task; of more, the sketches are joined to the documents' shingles by
    hash, and the candidates' texts to their items.
    """
    rows = items.select(F.col(item_col).alias("id"), utf8(item_text).alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    source = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    search = searched if total <= 4 * block else joined
    out = search(source, rows, words, contained, miss)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col if item_col != id_col else f"item_{item_col}")


def found_schema(source: DataFrame, rows: DataFrame) -> str:
    kind, item_kind = (df.schema["id"].dataType.simpleString() for df in (source, rows))
    return f"id {kind}, item {item_kind}, n_item long, n_shared long, containment double"


def searched(source: DataFrame, rows: DataFrame, words: int, contained: float, miss: float) -> DataFrame:
    """The matches of documents (id, data) with items (id, data) that a task can hold: their number is checked by the caller."""
    arrow = to_arrow_type(rows.schema["id"].dataType)
    held = source.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["data"])) for r in rows.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = Items(held.value, words, contained, miss), Hashes()
        for batch in batches:
            at, found = [], []
            for k, data in enumerate(batch.column(1)):
                for x in index.search(word_hashes(data.as_py(), cache)):
                    at.append(k)
                    found.append(x)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            which = pa.array([index.ids[i] for i, _, _ in found], arrow)
            n, shared = (pa.array([x[j] for x in found], pa.int64()) for j in (1, 2))
            share = pa.array([s / m for _, m, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([ids, which, n, shared, share], ["id", "item", "n_item", "n_shared", "containment"])

    return source.mapInArrow(run, found_schema(source, rows))


#: Bits of the filter that a document's shingles pass before they are joined.
SKETCH_BITS = 1 << 26


def joined(source: DataFrame, rows: DataFrame, words: int, contained: float, miss: float) -> DataFrame:
    """The matches of documents (id, data) with any number of items (id, data), in one pass over the documents.

    Sketches and the documents' shingles meet by hash; a pair with as many hits as the
    item needs is a candidate, whose texts are then joined and compared exactly. Equal
    texts are one document, equal items one item until the end.
    """
    digest = F.unhex(F.sha2("data", 256))
    things = cut(rows.withColumn("item_key", digest).dropDuplicates(["item_key"]).select("item_key", "data"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                index = Items([(0, data.as_py())], words, contained, miss)
                if index.ids:
                    n = len(index.keys)
                    keys = pa.array(index.keys.view(np.int64))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([key.as_py()] * n, pa.binary()), pa.array([int(index.need[0])] * n), pa.array([index.runs[0]] * n)], ["h", "item_key", "need", "run"])

    sketch = cut(things.mapInArrow(sketches, "h long, item_key binary, need long, run long"))
    runs = sorted(r["run"] for r in sketch.select("run").distinct().collect())
    place = F.pmod(F.col("h"), F.lit(SKETCH_BITS))
    bits = np.zeros(SKETCH_BITS // 8, np.uint8)
    # At most one row for each eight bits of the filter.
    for r in sketch.groupBy((place / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, CAST(pmod(h, {SKETCH_BITS}) % 8 AS INT))")).alias("bits")).toLocalIterator():
        bits[r["byte"]] = r["bits"]
    filter_ = source.sparkSession.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = filter_.value, Hashes()
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                hashes = word_hashes(data.as_py(), cache)
                for run in runs:
                    if len(hashes) < run:
                        continue
                    have = shingles(hashes, run)
                    at = have & np.uint64(SKETCH_BITS - 1)
                    have = np.unique(have[(known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                    if len(have):
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(have), pa.binary()), pa.array(have.view(np.int64)), pa.array([run] * len(have))], ["doc_key", "h", "run"])

    texts = source.where("octet_length(data) > 0").withColumn("doc_key", digest)
    met = texts.select("doc_key", "data").mapInArrow(hits, "doc_key binary, h long, run long").distinct().join(sketch, ["h", "run"])
    pairs = cut(met.groupBy("doc_key", "item_key").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("doc_key", "item_key"))
    wanted = pairs.select("doc_key").distinct()
    some = cut(likely_in(texts, "doc_key", wanted).join(wanted.hint("merge"), "doc_key"))
    both = pairs.join(some.dropDuplicates(["doc_key"]).select("doc_key", F.col("data").alias("text")), "doc_key").join(things, "item_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            out = []
            for doc, item, text, data in zip(*[c.to_pylist() for c in batch.columns]):
                found = Items([(0, data)], words, contained, miss).search(word_hashes(text, cache))
                out += [(doc, item, n, shared, shared / n) for _, n, shared in found]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()))], ["doc_key", "item_key", "n_item", "n_shared", "containment"])

    good = both.select("doc_key", "item_key", "text", "data").mapInArrow(verify, "doc_key binary, item_key binary, n_item long, n_shared long, containment double")
    names = rows.select(F.col("id").alias("item"), digest.alias("item_key"))
    out = good.join(some.select("doc_key", "id"), "doc_key").join(names, "item_key")
    return out.select("id", "item", "n_item", "n_shared", "containment")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose id and text contain an item; columns and other rows stay as they are."""
    name = F.struct(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).cast("string")
    named = docs.select(name.alias("name"), F.col(text_col).alias("text"))
    bad = cut(contaminated(named, items, "name", "text", **options).select("name").distinct())
    return without(docs, name, bad)
