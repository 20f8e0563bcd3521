"""Removing repeated byte strings by suffix order and longest-previous-factor arrays.

Every window of LENGTH bytes has a key that only depends on its bytes: the least hash of
the shorter strings inside it, rare ones before those that a sample shows to be frequent.
Equal windows have equal keys, so windows are dealt out by key, neighbouring ones of one
key as one region. Regions whose key is nowhere else have no repeats. Equal regions are
repeats as a whole, which their digests show. Of the different regions of one key, one of
each is sorted into suffix order. There, the nearest entry above or below that starts
earlier in the corpus is the longest earlier match, whose length is the longest previous
factor; likewise the nearest one that starts later. Keys of very many different regions
are dealt to blocks, and the blocks' distinct windows are then matched by digest.

The sample only decides which keys windows get, never what is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import cut, likely_in, maybe_in, mixed, saved, utf8

LENGTH = 400
#: Length of the strings whose least hash is a window's key.
GRAM = 64
#: Windows that are hashed together, and the most of one region.
CHUNK, REGION = 1 << 19, 1 << 14
#: Bytes of one block of a key, about, and of regions that are sorted together.
BLOCK_BYTES, SORT_BYTES = 1 << 19, 1 << 19
#: Documents and bytes of each that show which short strings are frequent, and how many documents make one so.
SAMPLE_DOCS, SAMPLE_BYTES, FREQUENT = 1000, 12_000, 6
FREQUENT_BIT = np.uint64(1 << 63)
BASE = 0x9E3779B97F4A7C15


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
    return up, down


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes."""
    n = len(data)
    up, down = powers(1 << max(10, (n + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        return mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values: of the end of one block and the start of the next."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


class Frequent:
    """Hashes of frequent short strings."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes & np.uint64((1 << 20) - 1)] = True

    def ranked(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes with the top bit set for frequent ones and clear for others, so that others are less."""
        out = hashes & ~FREQUENT_BIT
        if len(self.hashes):
            some = np.flatnonzero(self.bits[hashes & np.uint64((1 << 20) - 1)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            out[some[self.hashes[at] == hashes[some]]] |= FREQUENT_BIT
        return out


def regions(data: bytes, length: int, gram: int, frequent: Frequent) -> list[dict]:
    """Runs of windows of one key: key, first and last window, places of the key (at most 2), digest of the run's bytes."""
    whole, out = np.frombuffer(data, np.uint8), []
    for at in range(0, len(whole) - length + 1, CHUNK):
        part = whole[at : at + CHUNK + length - 1]
        hashes = frequent.ranked(gram_hashes(part, gram))
        least = window_least(hashes, length - gram + 1)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        firsts = np.unique(np.concatenate([[0], change, np.arange(REGION, len(least), REGION)]))
        lasts = np.append(firsts[1:], len(least)) - 1
        keys = least[firsts]
        for k, h, a, b in zip(keys, keys.view(np.int64).tolist(), firsts.tolist(), lasts.tolist()):
            places = int((hashes[a : b + length - gram + 1] == k).sum())
            digest = xxhash.xxh3_128_digest(data[at + a : at + b + length])
            out.append({"h": h, "a": at + a, "b": at + b, "places": min(2, places), "digest": digest})
    return out


class SuffixOrder:
    """Ranks of all suffixes of ``data`` by their first 8, 16, 32, ... bytes, by prefix doubling."""

    def __init__(self, data: np.ndarray, length: int):
        self.n, self.length = len(data), length
        padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
        self.data = padded
        first = np.zeros(self.n, np.uint64)
        for k in range(8):
            first = (first << np.uint64(8)) | padded[k : k + self.n]
        self.steps, self.ranks = [8], [self.ranked(first)]
        while self.steps[-1] * 2 <= length:
            step, rank = self.steps[-1], self.ranks[-1]
            self.ranks.append(self.ranked(rank.astype(np.int64) * (self.n + 2) + self.after(rank, step)))
            self.steps.append(step * 2)

    def after(self, rank: np.ndarray, step: int) -> np.ndarray:
        """The rank ``step`` bytes on; -1 past the end, kept from going below zero by adding 1."""
        out = np.zeros(self.n, np.int64)
        if step < self.n:
            out[:-step] = rank[step:] + 1
        return out

    def ranked(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        sorted_ = keys[order]
        out = np.empty(self.n, np.int32)
        out[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]), dtype=np.int32)
        return out

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in suffix order of their first ``length`` bytes, which must be there; equal ones by position."""
        step, rank = self.steps[-1], self.ranks[-1]
        return starts[np.lexsort((starts, rank[starts + self.length - step], rank[starts]))]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many leading bytes the suffixes at i and j share, at most ``length``."""
        out = np.zeros(len(i), np.int64)
        for step, rank in zip(reversed(self.steps), reversed(self.ranks)):
            for _ in range(2 if step == self.steps[-1] else 1):
                a, b = i + out, j + out
                inside = (np.maximum(a, b) < self.n) & (out < self.length)
                same = np.zeros(len(i), bool)
                same[inside] = rank[a[inside]] == rank[b[inside]]
                out += step * same
        for _ in range(7):
            a, b = np.minimum(i + out, self.n), np.minimum(j + out, self.n)
            out += (out < self.length) & (self.data[a] == self.data[b]) & (np.maximum(a, b) < self.n)
        return np.minimum(out, self.length)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """By entry, the place of the nearest entry before it that is smaller; -1 if there is none.

    Each entry skips from candidate to candidate; what lies between an entry and its
    candidate is always larger, so all entries can skip at the same time.
    """
    out = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[out[todo] >= 0]
        todo = todo[values[out[todo]] > values[todo]]
        out[todo] = out[out[todo]]
    return out


def factors(suffixes: SuffixOrder, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sources): by entry of ``ordered`` the longest match that starts earlier, capped, and where; source -1 for none."""
    above = nearest_smaller(ordered)
    below = len(ordered) - 1 - nearest_smaller(ordered[::-1])[::-1]
    best, source = np.zeros(len(ordered), np.int64), np.full(len(ordered), -1, np.int64)
    for near, there in ((above, above >= 0), (below, below < len(ordered))):
        size = np.zeros(len(ordered), np.int64)
        size[there] = suffixes.common(ordered[there], ordered[near[there]])
        better = size > best
        best[better], source[better] = size[better], ordered[near[better]]
    return best, source


def later_factors(suffixes: SuffixOrder, ordered: np.ndarray) -> np.ndarray:
    """By entry the length of the longest match that starts later, capped."""
    turned = -ordered
    above = nearest_smaller(turned)
    below = len(ordered) - 1 - nearest_smaller(turned[::-1])[::-1]
    best = np.zeros(len(ordered), np.int64)
    for near, there in ((above, above >= 0), (below, below < len(ordered))):
        best[there] = np.maximum(best[there], suffixes.common(ordered[there], ordered[near[there]]))
    return best


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (begin, end) joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Sorter:
    """Collects regions, sorts them together, and tells which bytes are repeated."""

    def __init__(self, length: int, keep_first: bool):
        self.length, self.keep_first = length, keep_first
        self.clear()

    def clear(self) -> None:
        self.found: list[tuple] = []
        self.size = 0

    def add(self, rank: int | None, key: bytes, start: int, split: bool, data: bytes) -> None:
        at = (rank is None, rank or 0, key, start)
        self.found.append((at, split, data))
        self.size += len(data)

    def result(self) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, bool, int, bytes, int]]]:
        """(text key, begin, end) of repeated bytes; (digest, rank is null, rank, text key, start) of split keys' distinct windows."""
        parts, seen = [], None
        for at, split, data in sorted(self.found, key=lambda x: x[0]):
            if at != seen:
                parts.append((at, split, data))
            seen = at
        self.clear()
        if not parts:
            return [], []
        sizes = np.array([len(d) for _, _, d in parts])
        bases = np.cumsum(sizes) - sizes
        text = b"".join(d for _, _, d in parts)
        starts = np.concatenate([np.arange(b, b + n - self.length + 1) for b, n in zip(bases.tolist(), sizes.tolist())])
        suffixes = SuffixOrder(np.frombuffer(text, np.uint8), self.length)
        ordered = suffixes.sort(starts)
        earlier, _ = factors(suffixes, ordered)
        marked = earlier >= self.length
        heads = ordered[~marked]
        if not self.keep_first:
            marked |= later_factors(suffixes, ordered) >= self.length
        hit = np.sort(ordered[marked])
        spans, cross = [], []
        owner = np.searchsorted(bases, hit, "right") - 1
        breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(owner) > 0)) + 1
        for run in np.split(np.arange(len(hit)), breaks) if len(hit) else []:
            (_, _, key, start), _, _ = parts[owner[run[0]]]
            base = bases[owner[run[0]]]
            spans.append((key, int(start + hit[run[0]] - base), int(start + hit[run[-1]] - base + self.length)))
        if any(split for _, split, _ in parts):
            who = np.searchsorted(bases, heads, "right") - 1
            for w, p in zip(who.tolist(), heads.tolist()):
                (null, rank, key, start), split, _ = parts[w]
                if split:
                    cross.append((xxhash.xxh3_128_digest(text[p : p + self.length]), null, rank, key, int(start + p - bases[w])))
        return spans, cross


def frequent_grams(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Hashes of the strings of ``gram`` bytes that FREQUENT or more of at most SAMPLE_DOCS documents have."""
    some = docs.where(F.octet_length("data").between(length, SAMPLE_BYTES)).select("key", "data")
    n = some.count()
    some = some.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE_DOCS / max(1, n)) * (1 << 30))).limit(SAMPLE_DOCS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.unique(gram_hashes(np.frombuffer(d.as_py(), np.uint8), gram)) for batch in batches for d in batch.column(1)]
        if found:
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n >= FREQUENT].view(np.int64))], ["h"])

    rows = some.coalesce(1).mapInArrow(count, "h long").collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def removed_spans(docs: DataFrame, length: int, gram: int, keep_first: bool, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): repeated bytes (key, begin, end) of distinct texts, and (key, rep, copies) of these."""
    texts = cut(docs.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    long_ = docs.where(F.octet_length("data") >= length)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, length, gram))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("places", pa.int64()), ("digest", pa.binary())]))
        known = Frequent(frequent.value)
        for batch in batches:
            rows = [regions(d.as_py(), length, gram, known) for d in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["key", "id", "runs"])

    found = long_.select("key", "id", "data").mapInArrow(keyed, "key binary, id long, runs array<struct<h:long,a:long,b:long,places:long,digest:binary>>")
    first = texts.select(F.col("key").alias("t_key"), "rep")
    one = F.col("key").eqNullSafe(F.col("t_key")) & F.col("id").eqNullSafe(F.col("rep"))
    runs = saved(found.join(first, one).dropDuplicates(["key"]).select("key", "rep", "runs"), "regions").select("key", "rep", F.inline("runs"))
    shared = cut(runs.groupBy("h").agg(F.sum("places").alias("n")).where("n > 1").select("h"))
    # Each run that may have a repeat, in order of the corpus.
    place = F.struct(F.col("rep").isNull().alias("null_rank"), F.col("rep").alias("rank"), "key", F.col("a").alias("begin"))
    runs = saved(likely_in(runs, "h", shared).join(shared, "h").withColumn("place", place), "candidates")
    kinds = runs.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"), F.max("places").alias("places"))
    kinds = cut(kinds)
    equal = runs.join(kinds.where("n > 1").select("h", "digest", "least"), ["h", "digest"])
    if keep_first:
        equal = equal.where(F.col("place") != F.col("least"))
    equal = equal.select("key", F.col("a").alias("begin"), (F.col("b") + length).alias("end"))
    # One of each different region of a key goes on if the key has several, or if it may repeat itself.
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("places").alias("places")).where("n > 1 OR places > 1")
    several = several.select("h", F.ceil(F.col("n") * 2 * length / block_bytes).cast("long").alias("blocks"))
    reps = runs.join(kinds.select("h", "digest", "least"), ["h", "digest"]).where(F.col("place") == F.col("least")).join(several, "h")
    wanted = reps.select("key", F.struct("h", F.pmod(F.xxhash64("key", "a"), F.col("blocks")).alias("salt"), (F.col("blocks") > 1).alias("split"), "a", "b").alias("run"))
    wanted = cut(wanted.groupBy("key").agg(F.collect_list("run").alias("runs")))
    sources = likely_in(long_, "key", wanted.select("key")).join(first, one).select("key", "rep", "data")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, rep, data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = data.as_py()
                for r in found:
                    part = data[r["a"] : r["b"] + length]
                    rows.append((r["h"], r["salt"], r["split"], rep, key, r["a"], part))
                    size += len(part)
                    if size >= 1 << 22:
                        yield batch_of(rows, REGION_SCHEMA)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows, REGION_SCHEMA)

    parts = sources.join(wanted, "key").select("key", "rep", "data", "runs").mapInArrow(cut_out, "h long, salt long, split boolean, rep long, key binary, a long, part binary")
    parts = parts.repartition("h", "salt").sortWithinPartitions("h", "salt")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, at = Sorter(length, keep_first), None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for h, salt, split, rep, key, a, part in zip(*columns):
                # Regions of one key and salt stay together; several small groups are sorted at once.
                if (h, salt) != at and sorter.size >= SORT_BYTES:
                    yield from results(sorter)
                at = (h, salt)
                sorter.add(rep, key, a, split, part)
        yield from results(sorter)

    found = cut(parts.mapInArrow(match, "key binary, begin long, end long, digest binary, null_rank boolean, rank long"))
    spans = found.where("digest IS NULL").select("key", "begin", "end")
    cross = found.where("digest IS NOT NULL")
    place = F.struct("null_rank", "rank", "key", "begin")
    many = cross.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).where("n > 1")
    more = cross.join(many, "digest")
    if keep_first:
        more = more.where(place != F.col("least"))
    return spans.unionAll(more.select("key", "begin", (F.col("begin") + length).alias("end"))).unionAll(equal), texts


REGION_SCHEMA = pa.schema([("h", pa.int64()), ("salt", pa.int64()), ("split", pa.bool_()), ("rep", pa.int64()), ("key", pa.binary()), ("a", pa.int64()), ("part", pa.binary())])
FOUND_SCHEMA = pa.schema([("key", pa.binary()), ("begin", pa.int64()), ("end", pa.int64()), ("digest", pa.binary()), ("null_rank", pa.bool_()), ("rank", pa.int64())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def results(sorter: Sorter) -> Iterator[pa.RecordBatch]:
    spans, cross = sorter.result()
    rows = [(k, a, b, None, None, None) for k, a, b in spans] + [(k, a, None, d, null, rank) for d, null, rank, k, a in cross]
    for at in range(0, len(rows), 50_000):
        yield batch_of(rows[at : at + 50_000], FOUND_SCHEMA)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans, kept (the remaining UTF-8 bytes).

    ``spans`` are the removed runs of bytes (begin, end). Removed is each byte that a
    string of ``length`` bytes covers which occurs elsewhere as well, in the same text or
    another; with ``keep_first`` the occurrence of smallest id, and in a text the first,
    stays. Strings are judged on the input. Equal texts are copies of each other from
    ``length`` bytes on. Null counts as empty; ids are longs, null ids come last; rows
    that repeat an id are texts of their own, but with ``keep_first`` rows that repeat the
    first id and its text stay together. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))
    spans, texts = removed_spans(rows, length, gram, keep_first, block_bytes)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    info = cut(texts.join(spans, "key", "left").where("copies > 1 OR spans IS NOT NULL"))
    # Most texts have no repeats; they don't move.
    marked = maybe_in(rows, "key", info.select("key"))
    joined = marked.where("__maybe").join(info.select(F.col("key").alias("t_key"), "rep", "copies", "spans"), F.col("key") == F.col("t_key"), "left")
    gone = (F.col("copies") > 1) & (F.octet_length("data") >= length)
    if keep_first:
        gone = gone & ~F.col("id").eqNullSafe(F.col("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans_, kept = [], [], []
            for data, found, whole in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = data.as_py()
                cuts = [(0, len(data))] if whole else merged([(s["begin"], s["end"]) for s in found or []])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                sizes.append(len(data))
                spans_.append([{"begin": a, "end": b} for a, b in cuts])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = joined.select("id", "data", "spans", F.coalesce(gone, F.lit(False)).alias("whole"))
    out = out.mapInArrow(run, "id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    rest = marked.where("NOT __maybe").select("id", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("spans"), F.col("data").alias("kept"))
    return out.unionAll(rest).withColumnRenamed("id", id_col)
