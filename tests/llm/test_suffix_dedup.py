import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import docs, sentence, with_clashes

from codehealth.llm import suffix_dedup as S


def brute(rows, n, keep_first):
    """By row: the removed spans. Rows in order of ids, nulls last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, (rows[k][1] or "")))
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1))
    seen, out = set(), {}
    for r in order:
        d, spans = data[r], []
        for k in range(len(d) - n + 1):
            w = d[k : k + n]
            if w in seen if keep_first else count[w] > 1:
                spans.append((k, k + n))
            seen.add(w)
        out[r] = S.merged(spans)
    return [out[k] for k in range(len(rows))]


@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_longest_previous_factors(parts):
    text = "".join(parts) + "a" * 12
    data = np.frombuffer(text.encode(), np.uint8)
    n = 12
    suffixes = S.SuffixOrder(data, n)
    starts = np.arange(len(data) - n + 1)
    ordered = suffixes.sort(starts)
    keys = [text[k : k + n] for k in ordered.tolist()]
    assert keys == sorted(keys)
    lengths, sources = S.factors(suffixes, ordered)

    def common(i, j):
        k = 0
        while k < n and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    for place, i in enumerate(ordered.tolist()):
        want = max((common(i, j) for j in range(i)), default=0)
        assert lengths[place] == want
        assert want == 0 or (sources[place] < i and common(i, int(sources[place])) == want)
        assert S.later_factors(suffixes, ordered)[place] == max((common(i, j) for j in starts.tolist() if j > i), default=0)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_nearest_smaller(values):
    got = S.nearest_smaller(np.array(values)).tolist()
    assert got == [next((j for j in range(i - 1, -1, -1) if values[j] <= values[i]), -1) for i in range(len(values))]


def corpus():
    rng = random.Random(21)
    passage, other = sentence(rng, 30), sentence(rng, 25)
    rows = [(k, sentence(rng, rng.randrange(1, 60)) + " " + (passage if k % 3 == 0 else "") + " " + sentence(rng, 10) + (other if k % 7 == 0 else "")) for k in range(30)]
    rows += [(50, "ab" * 400), (51, "x" + "ab" * 90), (52, rows[4][1]), (53, rows[4][1]), (54, None), (55, ""), (56, "short"), (57, "short"), (58, "naïve über " * 30)]
    rows += [(60, sentence(rng, 4000)), (61, passage * 3)]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("block", [1 << 19, 400])
def test_against_brute_force(spark, monkeypatch, keep_first, block):
    monkeypatch.setattr(S, "SORT_BYTES", 2000)
    rows = corpus()
    table = with_clashes(docs(spark, rows), "id", "key", "data", "spans", "rep")
    got = {r["doc_id"]: r for r in S.without_repeats(table, length=100, gram=20, keep_first=keep_first, block_bytes=block).collect()}
    for (i, text), spans in zip(rows, brute(rows, 100, keep_first)):
        data = (text or "").encode()
        assert got[i]["n_bytes"] == len(data)
        assert [(s["begin"], s["end"]) for s in got[i]["spans"]] == spans, i
        edges = [0, *(x for s in spans for x in s), len(data)]
        assert got[i]["kept"] == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def test_chunks_and_regions_change_nothing(spark, monkeypatch):
    rows = corpus()
    want = {r["doc_id"]: r["spans"] for r in S.without_repeats(docs(spark, rows), length=100, gram=20, keep_first=False).collect()}
    monkeypatch.setattr(S, "CHUNK", 150)
    monkeypatch.setattr(S, "REGION", 40)
    found = [S.regions(t.encode(), 100, 20, S.Frequent(np.zeros(0, np.uint64))) for _, t in rows if t]
    assert all(r["b"] - r["a"] < 40 for f in found for r in f) and want


def test_repeated_rows_null_ids_and_empty_table(spark):
    long_ = "abc " * 60
    got = S.without_repeats(docs(spark, [(1, long_), (1, long_), (None, long_), (2, "unique text " + "q" * 20)]), length=100, gram=20, keep_first=False).collect()
    assert sorted((len(r["kept"]), r["n_bytes"]) for r in got) == [(0, 240), (0, 240), (0, 240), (32, 32)]
    assert S.without_repeats(docs(spark, []), length=100, gram=20).collect() == []
