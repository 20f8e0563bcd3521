"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the distribution of its word shingles, weighted by how often each occurs.
Each shingle starts a Poisson process whose rate is its weight; each arrival goes to a
random component of the signature, and a component keeps the shingle that arrived first.
Two signatures agree in a component with the probability Jaccard similarity. Arrivals
later than every component's first one can't matter, which ends the work early.

Documents that agree in a band of components are candidates. Among the documents of one
band key, some are heads: every document agrees with a head in a share COVERED of its
components, and is linked to all heads with which it agrees so far that, through it, a
similar document could agree with it as well. So documents that the signatures let be
similar get into one cluster, while unlike ones that only share a band don't. A key of
many documents is dealt to parts that have the same heads, more of them each round, until
the documents that no head covers fit one part. No texts are needed for this.

Clusters are dealt to blocks of bounded size; inside a block, pairs of similar signature
are verified by their exact similarity until all are known to be connected or not. Some
documents of a large cluster, its anchors, are in all of its blocks and join the blocks'
classes; what they don't join visits every block, so that no pair of different classes
goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import Hashes, cut, join_groups, likely_in, mixed, shingles, utf8, without, word_hashes
from codehealth.llm.components import connected

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 28, 5
#: A pair is verified if its signatures' agreement is within this many standard deviations of SIMILAR.
DEVIATIONS = 4.5
#: Similarities this close to SIMILAR are compared in integers; far more than sums of floats are off.
ROUNDING = 1e-6
#: The share of components in which a document agrees with a head that covers it.
COVERED = 0.85
#: Documents of one part of a band key, about, and heads of a key of several parts in its first round.
PART_DOCS, HEADS = 4096, 64
#: Documents and bytes of a block, about, and documents that are in all blocks of a cluster, about.
BLOCK_DOCS, BLOCK_BYTES, ANCHORS = 512, 1 << 23, 64


def weighted(data: bytes, words: int, cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and how often each occurs."""
    return np.unique(shingles(word_hashes(data, cache), words), return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The shingle that arrives first at each component; no signature for no shingle."""
    first, best = np.full(size, np.inf), np.zeros(size, np.uint64)
    at, left, rate, turn = np.zeros(len(keys)), keys, weights.astype(float), 1
    wanted = int(size * (np.log(size) + 1.5))
    with np.errstate(over="ignore"):
        while len(left):
            # Several arrivals of each process at once, so that few shingles need few rounds.
            n = max(1, -(-wanted // len(left)))
            steps = np.arange(turn, turn + n, dtype=np.uint64)
            draw = mixed(left[:, None] + steps[None, :] * np.uint64(0x9E3779B97F4A7C15))
            wait = -np.log(((draw >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / rate[:, None]
            times = at[:, None] + np.cumsum(wait, 1)
            where = (mixed(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)
            t, w = times.ravel(), where.ravel()
            owner = np.repeat(left, n)
            late = first.max()
            if np.isfinite(late):
                near = t < late
                t, w, owner = t[near], w[near], owner[near]
            order = np.argsort(-t, kind="stable")
            new, who = np.full(size, np.inf), np.zeros(size, np.uint64)
            new[w[order]], who[w[order]] = t[order], owner[order]
            sooner = new < first
            first[sooner], best[sooner] = new[sooner], who[sooner]
            on = times[:, -1] < first.max()
            at, left, rate, turn = times[on, -1], left[on], rate[on], turn + n
            wanted = size
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of components, different between bands."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for part in sig[: bands * rows].reshape(bands, rows).T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard: the chance that the two sets' first arrivals are one shingle.

    A shared shingle d is first in both with chance 1 / sum(max(x/x_d, y/y_d)); where
    x/y is at least x_d/y_d the maximum is x/x_d, so sorted ratios make every sum a
    difference of running sums.
    """
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1] / a[1].sum()
    y[np.searchsorted(keys, b[0])] = b[1] / b[1].sum()
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    above = np.concatenate([[0.0], np.cumsum(x[::-1])])[::-1]
    below = np.concatenate([[0.0], np.cumsum(y)])
    cut_ = np.searchsorted(ratio, ratio[both], "left")
    return float((1 / (above[cut_] / x[both] + below[cut_] / y[both])).sum())


def exact_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Fraction:
    """``similarity`` without rounding, by whole counts: shingles of one ratio have one denominator."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    x[np.searchsorted(keys, a[0])], y[np.searchsorted(keys, b[0])] = a[1], b[1]
    pairs, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    by_ratio: dict[Fraction, list[int]] = {}
    above, below, out = 0, 0, Fraction(0)
    for (p, q), k in zip(pairs.tolist(), n.tolist()):
        if q:
            sums = by_ratio.setdefault(Fraction(p, q), [0, 0])
            sums[0] += p * k
            sums[1] += q * k
        # A ratio without end is above all others.
        above += p * k
    for ratio in sorted(by_ratio):
        p, q = by_ratio[ratio]
        if p:
            out += Fraction(p * ratio.denominator, above * ratio.denominator + below * ratio.numerator)
        above, below = above - p, below + q
    return out


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similar: float) -> bool:
    """Whether the exact similarity is ``similar`` or more, ``similar`` taken as the decimal number it is written as."""
    found = similarity(a, b)
    if abs(found - similar) > ROUNDING:
        return found >= similar
    return exact_similarity(a, b) >= Fraction(repr(float(similar)))


def least_agreement(similar: float, size: int) -> float:
    """The share of components in which similar documents agree, but for a chance that DEVIATIONS make small."""
    return float(similar - DEVIATIONS * np.sqrt(similar * (1 - similar) / size))


class Block:
    """Documents of one block: their signatures and weighted shingles, and who is connected with whom."""

    def __init__(self, words: int, similar: float, size: int):
        self.words, self.similar, self.size = words, similar, size
        self.least = least_agreement(similar, size)
        self.ids: list[int] = []
        self.known: list[int] = []
        self.visits: list[bool] = []
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, id_: int, known: int, visits: bool, found: tuple[np.ndarray, np.ndarray]) -> None:
        if len(found[0]):
            self.ids.append(id_)
            self.known.append(known)
            self.visits.append(visits)
            self.sets.append(found)

    def links(self) -> list[tuple[int, int]]:
        """Verified pairs that connect all documents of the block that belong together.

        Documents of one ``known`` class count as connected. Where there are visitors,
        pairs of two residents have been looked at before.
        """
        n = len(self.ids)
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        heads: dict[int, int] = {}
        for i, k in enumerate(self.known):
            root[find(i)] = find(heads.setdefault(k, i))
        sigs = np.array([signature(*s, self.size) for s in self.sets]).reshape(n, self.size)
        late, out = any(self.visits), []
        order = sorted(range(n), key=lambda i: self.visits[i])
        sigs = sigs[order]
        for place, i in enumerate(order):
            if late and not self.visits[i]:
                continue
            agree = (sigs[:place] == sigs[place]).mean(1)
            near = np.flatnonzero(agree >= self.least)
            for p in near[np.argsort(-agree[near], kind="stable")].tolist():
                j = order[p]
                if find(i) != find(j) and alike(self.sets[i], self.sets[j], self.similar):
                    root[find(i)] = find(j)
                    out.append((self.ids[i], self.ids[j]))
        return out


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, keys, marks, size) of every document (id, data); ``marks``: the lowest byte of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for batch in batches:
            keys, marks = [], []
            for data in batch.column(1):
                found = weighted(data.as_py(), words, cache)
                sig = signature(*found, bands * rows) if len(found[0]) else np.zeros(0, np.uint64)
                keys.append(band_keys(sig, bands, rows) if len(sig) else np.zeros(0, np.int64))
                marks.append(sig.astype(np.uint8).tobytes())
            sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(marks, pa.binary()), batch.column(2)], ["id", "keys", "marks", "size"])

    return docs.select("id", "data", F.octet_length("data").cast("long").alias("size")).mapInArrow(run, "id long, keys array<long>, marks binary, size long")


def linked_heads(ids: np.ndarray, marks: np.ndarray, heads: np.ndarray, lone: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of ids, which documents no head covers) of one part of a key; a lone part takes heads from those left until none is.

    The pairs hang each document on the least id of those that the heads join it to.
    """
    open_, group = ~heads, np.arange(len(ids))
    todo, left = np.flatnonzero(heads).tolist(), 0
    while True:
        if not todo:
            while left < len(ids) and not open_[left]:
                left += 1
            if not lone or left == len(ids):
                break
            todo = [left]
        head = todo.pop()
        agree = (marks == marks[head]).mean(1)
        near = group[agree >= COVERED + least - 1]
        if (near != near[0]).any():
            joined = np.zeros(len(ids), bool)
            joined[near] = True
            group[joined[group]] = near.min()
        open_ &= agree < COVERED
    # Documents come in order of their ids, so a group's number is the place of its least id.
    first = ids[group]
    return np.stack([ids, first])[:, ids != first], open_


def candidate_links(sigs: DataFrame, similar: float, size: int, part_docs: int, heads: int) -> DataFrame:
    """Links (u, v) that connect all documents (id, keys, marks) which agree in a band and, by their signatures, may be similar."""
    least = least_agreement(similar, size)
    spread = sigs.select("id", "marks", F.explode("keys").alias("key"))
    often = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    left = join_groups(likely_in(spread, "key", often.select("key")), often, "key", "n").select("key", "id", "marks", "n")
    out = None
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def results() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            ids = np.array([r[0] for r in rows], np.int64)
            marks = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
            lone = now[2] == 1
            pairs, open_ = linked_heads(ids, marks, np.array([r[2] for r in rows]) & (not lone), lone, least)
            u, v = pairs
            if len(u):
                none = [None] * len(u)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(none, pa.int64()), pa.array(none, pa.binary())], schema=schema)
            over = [rows[k] for k in np.flatnonzero(open_)]
            if over:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in over], pa.int64()), pa.array([None] * len(over), pa.int64()), pa.array([now[0]] * len(over), pa.int64()), pa.array([r[1] for r in over], pa.binary())], schema=schema)

        for batch in batches:
            for key, part, parts, id_, mark, head in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, part, parts) != now:
                    yield from results()
                    now, rows = (key, part, parts), []
                rows.append((id_, mark, head))
        yield from results()

    for round_ in range(64):
        parts = F.ceil(F.col("n") / part_docs).cast("int")
        head = (F.col("parts") > 1) & (share("id", round_ + 2) < F.lit(float(heads << round_)) / F.col("n"))
        home = F.array(F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
        dealt = left.withColumn("parts", parts).withColumn("head", head)
        dealt = dealt.select("key", F.explode(F.when(F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(home)).alias("part"), "parts", "id", "marks", "head")
        dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "id")
        found = cut(dealt.mapInArrow(run, "u long, v long, key long, marks binary"))
        links = found.where("v IS NOT NULL").select("u", "v")
        out = links if out is None else out.unionAll(links)
        left = found.where("v IS NULL").select("key", F.col("u").alias("id"), "marks")
        if left.isEmpty():
            return out
        sizes = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        left = join_groups(left, sizes, "key", "n").select("key", "id", "marks", "n")
    raise RuntimeError("band keys did not settle")


def verified(members: DataFrame, docs: DataFrame, words: int, similar: float, size: int) -> DataFrame:
    """Links (u, v) that the blocks of ``members`` (cluster, block, id, known, visits) verify."""
    rows = members.hint("merge").join(docs, "id").select("cluster", "block", "id", "known", "visits", "data")
    dealt = rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key, block, out = Hashes(), None, Block(words, similar, size), []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for c, b, id_, known, visits, data in zip(*columns, batch.column(5)):
                if (c, b) != key:
                    out += block.links()
                    key, block = (c, b), Block(words, similar, size)
                block.add(id_, known, visits, weighted(data.as_py(), words, cache))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])
                out = []
        out += block.links()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def share(column: str, salt: int):
    """A number from 0 to 1 that follows from the id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(salt)), 11) * F.lit(2.0**-53)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES, anchors: int = ANCHORS, part_docs: int = PART_DOCS, heads: int = HEADS) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size (rows), kept.

    Documents are linked if their texts are equal (null counts as empty) or their
    shingles' probability Jaccard similarity is ``similar`` or more; classes are the
    links' connected components, named by their largest id, whose row is kept. A text of
    fewer than ``words`` words is one shingle; texts without a word are linked only if
    equal. Rows of one id are one document. Rows without an id are kept, each in no class.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data"))
    keyed = rows_.where("id IS NOT NULL")
    digests = keyed.select("id", F.sha2("data", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.max("id").alias("rep"))
    copy_of = cut(digests.join(firsts, "digest").select("id", "rep"))
    # Each text is signed once; only rows that may be copies move for that.
    copies = cut(copy_of.groupBy("id").agg(F.bool_or(F.col("id") == F.col("rep")).alias("first")).where("NOT first").select("id"))
    signing = without(keyed, F.col("id"), copies)
    sigs = cut(signed(signing, words, bands, rows))
    candidates = connected(candidate_links(sigs, similar, bands * rows, part_docs, heads))

    sized = candidates.join(sigs.groupBy("id").agg(F.max("size").alias("size")), F.col("vertex") == F.col("id")).select("id", F.col("root").alias("cluster"), "size")
    totals = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    totals = totals.select("cluster", "n", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks"))
    homes = cut(sized.join(totals, "cluster").withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).drop("size"))
    # The join is the same at every size, and the candidates' texts are moved once for both passes.
    wanted = homes.select("id")
    texts = cut(likely_in(keyed, "id", wanted).join(wanted.hint("merge"), "id"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    anchor = (F.col("blocks") > 1) & (share("id", 1) < F.lit(float(anchors)) / F.col("n"))
    members = homes.select("cluster", "id", F.col("id").alias("known"), F.lit(False).alias("visits"), F.explode(F.when(anchor, everywhere).otherwise(F.array("home"))).alias("block"))
    links = cut(verified(members, texts, words, similar, bands * rows))

    wide = cut(homes.where("blocks > 1"))
    if not wide.isEmpty():
        found = connected(links)
        known = cut(wide.join(found, F.col("id") == F.col("vertex"), "left").withColumn("known", F.coalesce("root", "id")).drop("vertex", "root"))
        parts = known.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("m"))
        main = parts.groupBy("cluster").agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        open_ = known.join(main, "cluster")
        residents = open_.select("cluster", "id", "known", F.lit(False).alias("visits"), F.col("home").alias("block"))
        visitors = open_.where("known <> main").select("cluster", "id", "known", "home", F.explode(everywhere).alias("block")).where("block <> home")
        visitors = visitors.select("cluster", "id", "known", F.lit(True).alias("visits"), "block")
        links = links.unionAll(cut(verified(residents.unionByName(visitors), texts, words, similar, bands * rows)))

    roots = connected(links)
    label = copy_of.join(roots, F.col("rep") == F.col("vertex"), "left").select("id", F.coalesce("root", "rep").alias("root"))
    # An id with several texts is one document: its texts' classes are one class.
    several = label.groupBy("id").agg(F.min("root").alias("u"), F.max("root").alias("v"))
    if not (again := cut(several.where("u <> v").select("u", "v"))).isEmpty():
        joined = connected(again)
        label = label.join(joined, F.col("root") == F.col("vertex"), "left").select("id", F.coalesce(joined["root"], label["root"]).alias("root"))
    label = cut(label)
    classes = label.groupBy("root").agg(F.max("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = label.join(classes, "root").select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
    lone = rows_.where("id IS NULL").select(F.col("id").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionAll(lone)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``near_classes`` doesn't keep; columns stay as they are."""
    lost = cut(near_classes(docs, id_col, text_col, **options).where("NOT kept").select(F.col(id_col).alias("id")).distinct())
    return without(docs, F.col(id_col).cast("long"), lost)
