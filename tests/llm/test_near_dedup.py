import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import docs, sentence, with_clashes

from codehealth.llm import common
from codehealth.llm.components import connected
from codehealth.llm.near_dedup import alike, candidate_links, exact_similarity, near_classes, near_dedup, signature, signed, similarity, weighted


def brute_similarity(a: dict, b: dict) -> float:
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def shares(text):
    w = common.words((text or "").encode())
    n = min(5, len(w))
    c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
    return {k: v / sum(c.values()) for k, v in c.items()}


@given(st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1), st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1))
@settings(max_examples=200, deadline=None)
def test_similarity_against_its_definition(a, b):
    arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    exact = brute_similarity({k: v / sum(a.values()) for k, v in a.items()}, {k: v / sum(b.values()) for k, v in b.items()})
    assert similarity(*arrays) == pytest.approx(exact)


@given(st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1), st.dictionaries(st.integers(0, 9), st.integers(1, 5), min_size=1))
@settings(max_examples=200, deadline=None)
def test_exact_similarity_against_its_definition(a, b):
    arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    m, n = sum(a.values()), sum(b.values())
    x, y = ({k: Fraction(v, s) for k, v in c.items()} for c, s in ((a, m), (b, n)))
    want = sum((1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys()), Fraction(0))
    assert exact_similarity(*arrays) == want


def plain_set(first, size):
    return np.arange(first, first + size, dtype=np.uint64), np.ones(size, np.int64)


def test_the_threshold_itself_is_similar_enough():
    for u in range(5, 400, 5):
        shared = 4 * u // 5
        for own in range(u - shared + 1):
            a, b = plain_set(0, shared + own), plain_set(own, u - own)
            want = exact_similarity(a, b)
            assert alike(a, b, 0.8) == (want >= Fraction(4, 5))
            if own in (0, u - shared):
                assert want == Fraction(4, 5)
    assert not alike(plain_set(0, 4000), plain_set(0, 5001), 0.8)


def test_copies_at_the_threshold_are_linked(spark):
    rows, want = [], {}
    for k, (n, change) in enumerate([(49, lambda w: [*w[:24], "other", *w[25:]]), (13, lambda w: [*w[:-1], "other"]), (16, lambda w: [*w, "x", "y", "z"])]):
        text = [f"w{k}x{j}" for j in range(n)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(change(text)))]
        want |= {2 * k: 2 * k + 1, 2 * k + 1: 2 * k + 1}
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs(spark, rows)).collect()} == want


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    for _ in range(4):
        keys = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        a = (np.sort(keys[:150]), rng.integers(1, 6, 150))
        b = (np.sort(keys[40:]), rng.integers(1, 6, 160))
        got = (signature(*a, 3000) == signature(*b, 3000)).mean()
        assert got == pytest.approx(similarity(a, b), abs=0.04)
    one = (np.array([7], np.uint64), np.array([3]))
    assert set(signature(*one, 140).tolist()) == {7}


def brute_classes(rows):
    texts = defaultdict(list)
    for i, t in rows:
        if i is not None:
            texts[t or ""].append(i)
    root = {i: i for ids in texts.values() for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for ids in texts.values():
        for i in ids[1:]:
            root[find(i)] = find(ids[0])
    sets = [(ids[0], shares(t)) for t, ids in texts.items()]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and brute_similarity(a, b) >= 0.8:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in root:
        groups[find(i)].append(i)
    return {i: max(ids) for ids in groups.values() for i in ids}


def corpus():
    rng = random.Random(9)
    rows, n = [], 0
    passage = sentence(rng, 60)
    for k in range(25):
        base = sentence(rng, rng.randrange(80, 200)).split()
        for c in range(1 + k % 4):
            copy = list(base)
            for _ in range(c if k % 2 else 6 * c):
                copy[rng.randrange(len(copy))] = "swap" + str(rng.randrange(99))
            rows.append((n := n + 1, " ".join(copy) + (" " + passage if k % 5 == 0 else "")))
        rows.append((n := n + 1, " ".join(base).upper()))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "..."), (n + 4, "a b"), (n + 5, "A, b"), (n + 5, "A, b"), (n + 6, "word " * 60_000), (n + 7, "word " * 60_000 + "x")]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_docs": 3, "anchors": 1, "part_docs": 2, "heads": 1}])
def test_classes_against_brute_force(spark, options):
    rows = corpus()
    table = with_clashes(docs(spark, [*rows, (None, "lost id")]), "id", "key", "data", "root", "size")
    got = near_classes(table, **options).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(rows) + 1 and [r["kept"] for r in got if r["doc_id"] is None] == [True]
    sizes = Counter(want[i] for i, _ in rows)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)


def test_unlike_documents_of_one_paragraph_are_no_candidates(spark):
    rng = random.Random(12)
    passage = sentence(rng, 60)
    rows = [(k, sentence(rng, 70) + " " + passage) for k in range(600)]
    rows += [(1000 + k, text.replace("alpha1 ", "beta2 ", 1) + " end") for k, text in rows[:40]]
    table = docs(spark, rows).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
    sigs = signed(table, 5, 28, 5)
    keys = sigs.select("id", F.explode("keys").alias("key"))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] > 10
    for options in ((4096, 64), (4, 1)):
        links = candidate_links(sigs, 0.8, 140, *options).distinct().collect()
        assert {(r["u"] % 1000, r["v"] % 1000) for r in links if r["u"] % 1000 == r["v"] % 1000} == {(k, k) for k in range(40)}
        assert len(links) < 100


def test_one_of_each_class_stays(spark):
    rows = corpus()
    table = with_clashes(docs(spark, rows), "__id")
    kept = near_dedup(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(brute_classes(rows).values())


def test_empty_table(spark):
    assert near_classes(docs(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["vertex"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root}
