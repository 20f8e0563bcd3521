import random
import zlib

import numpy as np
import pytest
from tests.llm.helpers import DOCS, docs, sentence, with_clashes

from codehealth.llm import quality as Q


def corpus(n=240):
    rng, rows, labels = random.Random(7), [], []
    for k in range(n):
        lines = [sentence(rng, rng.randrange(4, 15)) + "." for _ in range(rng.randrange(1, 9))]
        good = k % 4 != 0
        if not good:
            lines = [" ".join(w + rng.choice(["***", "###", "%%%"]) for w in line.split()) for line in lines]
        rows.append((k, "\n".join(lines), "en", "s", 0))
        labels.append((k, int(good), 0))
    return rows, labels


def brute_counts(line: bytes) -> list[int]:
    found = line.replace(b"\t", b" ").split(b" ")
    found = [w for w in found if w]
    again = sum(a == b for a, b in zip(found, found[1:]))
    return [len(found), again, len(found) - len(set(found)), sum(not any(chr(c).isalnum() and c < 128 or c >= 128 for c in w) for w in found)]


def test_line_counts_against_brute_force():
    texts = [b"", b"a a b\n\n  c --- c\tc", "Über über 12 | |\n".encode(), b"\n\n", b"x"]
    x, size, lines = Q.line_features(texts)
    want = [line for t in texts for line in t.split(b"\n")]
    assert lines.tolist() == [len(t.split(b"\n")) for t in texts] and size.tolist() == [max(1, len(w)) for w in want]
    for row, line in zip(x, want):
        n, again, seen, marks = brute_counts(line)
        assert row[12:15] == pytest.approx(np.array([again, seen, marks]) / max(1, n))
        assert row[7] == pytest.approx(np.log1p(len(line)) / 8)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    x, lines = rng.normal(size=(7, Q.OWN)), np.array([3, 1, 3])
    field = Q.Field(rng.normal(size=Q.ALL), rng.normal(size=(2, 2)))
    got, e = field.marginals(x, lines), Q.chained(x, lines) @ field.weights
    at = 0
    for n in lines:
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert got[at : at + n] == pytest.approx(good / total)
        at += n


def test_long_chains_and_long_texts():
    rng = np.random.default_rng(5)
    field = Q.Field(rng.normal(size=Q.ALL), rng.normal(size=(2, 2)))
    for n in (1, 2, 3, 10, 137):
        e = rng.normal(size=n) * 3
        for got, want in zip(Q.long_messages(e, field.transitions), Q.messages(e, Q.Chains(np.array([n])), field.transitions)):
            assert got == pytest.approx(want)
    lines = [" ".join("ab1#-"[k] * rng.integers(1, 6) for k in rng.integers(0, 5, rng.integers(0, 9))) for _ in range(300)]
    for text in ("\n".join(lines), "\n".join(lines) + "\n", "\n" * 40, "one line " * 50, "\n" + lines[0]):
        whole = field.scores([text.encode()])
        assert field.long_score(text.encode(), 16) == pytest.approx(whole[0])
    assert Q.chains_of(b"a\nb\nc\nd\ne", 2) == [b"a\nb", b"b\nc", b"d\ne"] and Q.chains_of(b"a\nb", 2) == [b"a\nb"]


def test_held_out_accuracy_and_reruns(spark):
    rows, labels = corpus()
    table = with_clashes(spark.createDataFrame(rows, DOCS), "id", "data", "score", "good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in Q.quality(table, marks).collect()}
    truth = {k: q for k, q, _ in labels}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert len(held) > 20 and all(r["predicted"] == truth[r["doc_id"]] == int(r["score"] >= 0.3) for r in held)
    again = {r["doc_id"]: r["score"] for r in Q.quality(table.repartition(5), marks).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in got.items()}, abs=1e-9)


def test_edge_cases(spark):
    rows, labels = corpus(60)
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "\n" * 5, "en", "s", 0), (1003, "word " * 500_000, "en", "s", 0), (None, "text", None, None, None), (1001, "", "en", "s", 0)]
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1001, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(spark.createDataFrame(rows + odd, DOCS), marks).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in Q.quality(docs(spark, [(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert Q.quality(docs(spark, []), none).collect() == []
