import random

import numpy as np
import pytest
from tests.llm.helpers import DOCS, docs, with_clashes

from codehealth.llm.mixing import balance, capped_shares, copies, mix, mixed_docs


def corpus(n=900):
    rng = random.Random(3)
    sources = ["a", "b", "c", "d", None]
    return [(k, "w " * int(rng.paretovariate(1.8) * 3), "en", sources[min(4, int(rng.random() ** 2 * 6))], 0) for k in range(n)]


def test_shares_are_capped_and_shared_again():
    out = capped_shares({"a": 10, "b": 100, "c": 1000}, {"a": 5, "b": 2, "c": 1})
    assert out["a"] == 30 and out["b"] == 300 and out["c"] == pytest.approx(780)
    assert capped_shares({}, {}) == {} and capped_shares({"a": 0}, {"a": 5}) == {"a": 0}


def test_each_source_meets_its_target(spark):
    rows = corpus()
    table = with_clashes(spark.createDataFrame(rows, DOCS), "id", "size", "rate", "target", "chain", "copies")
    got = mix(table).collect()
    assert len(got) == len(rows)
    by_id, source = {r["doc_id"]: r for r in got}, {r[0]: r[3] for r in rows}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in set(source.values())}
    order = sorted(s for s in sizes if s) + [None]
    want = capped_shares(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in sizes:
        mine = [r for i, r in by_id.items() if source[i] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(want[s], rel=0.02, abs=5)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(table).collect()), key=str)


def test_two_constraints_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(1, 50)), "abc"[int(rng.integers(3))], "xy"[int(rng.integers(2))]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, size long, s string, l string")
    total = sum(r[1] for r in rows)
    targets = [{"a": 0.5 * total, "b": 0.3 * total, "c": 0.2 * total}, {"x": 0.4 * total, "y": 0.6 * total}]
    lam = balance(df, ["s", "l"], targets)
    rate = {r[0]: min(3.0, np.exp(lam[0][r[2]] + lam[1][r[3]])) for r in rows}
    for k, t in ((2, targets[0]), (3, targets[1])):
        for v, goal in t.items():
            assert sum(r[1] * rate[r[0]] for r in rows if r[k] == v) == pytest.approx(goal, rel=1e-4)


@pytest.mark.parametrize("ratio", [0.01, 0.5, 1.0, 2.0, 2.6, 2.9, 2.999, 3.0])
def test_every_ratio_up_to_the_cap_is_met(spark, ratio):
    df = spark.createDataFrame([(100, "a"), (700, "b"), (200, "b")], "size long, s string")
    lam = balance(df, ["s"], [{"a": 100 * ratio, "b": 900 * 0.7}])[0]
    assert min(3.0, np.exp(lam["a"])) == pytest.approx(ratio, rel=1e-5) and np.exp(lam["b"]) == pytest.approx(0.7)


def test_rounding_hands_errors_on(spark):
    rows = [(k, 1 + k % 9, 0.37, "s") for k in range(500)]
    got = copies(spark.createDataFrame(rows, "id long, size long, rate double, chain string"), ["chain"]).collect()
    assert abs(sum(r["copies"] * r["size"] for r in got) - sum(r["size"] * 0.37 for r in got)) <= 1


def test_edge_cases(spark):
    assert mix(docs(spark, [])).collect() == []
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one", "en", "a", 0), (3, "one", "en", "a", 0), (None, "two words", "en", None, 0)]
    got = sorted(mix(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 1, 1, 2]
    table = with_clashes(spark.createDataFrame(corpus(50), DOCS), "mix_copies")
    kept = mixed_docs(table)
    assert kept.columns == [*table.columns, "_mix_copies", "mix_taken"] and all(r["_mix_copies"] > 0 for r in kept.collect())


def test_rows_taken_meet_the_targets_without_their_texts(spark):
    rows = corpus(400) + [(7, "same words again", "en", "a", 0)] * 5 + [(7, "other words", "en", "a", 0), (None, "no id", "en", None, 0), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS)
    got = mixed_docs(table).collect()
    size = lambda t: len((t or "").split())
    assert all(r["mix_taken"] == size(r["text"]) * r["mix_copies"] and 1 <= r["mix_copies"] <= 3 for r in got)
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    targets = capped_shares(sizes, {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sources)})
    longest = max(size(r[1]) for r in rows)
    for s in sources:
        assert abs(sum(r["mix_taken"] for r in got if r["source"] == s) - targets[s]) <= longest
    again = sum(r["text"] == "same words again" for r in got)
    assert again in (0, 5) and len({r["mix_copies"] for r in got if r["text"] == "same words again"}) <= 1
    left = [tuple(r)[:5] for r in got]
    assert all(left.count(r) <= rows.count(r) for r in left)
    assert mixed_docs(table.limit(0)).collect() == []
