import random
from collections import Counter

from tests.llm.helpers import DOCS, docs, with_clashes

from codehealth.llm import language_id as L

WORDS = {"en": "the and thing other with house there".split(), "de": "der und ich über schön straße nicht".split(), "xx": "ŋalo ŋuma kiŋu woŋe".split()}


def corpus(n=120):
    rng = random.Random(5)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(40)), lang, "s", 0) for k, lang in zip(range(n), list(WORDS) * n)]


def brute_ngrams(text):
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for w in spaced.split():
        padded = f" {w} "
        for n in (1, 2, 3):
            out.update(g for g in (padded[k : k + n] for k in range(len(padded) - n + 1)) if g.strip() and not (len(g) == 3 and g[1] == " "))
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_ngrams_against_brute_force(monkeypatch):
    text = "The höuse, the 1 cat's\n\n ÄÖ a"
    for chunk in (1 << 20, 7, 3):
        monkeypatch.setattr(L, "CHUNK", chunk)
        codes, counts = L.ngrams(text)
        want = {code(g): n for g, n in brute_ngrams(text).items()}
        assert dict(zip(codes.tolist(), counts.tolist())) == want


def test_rank_and_distance():
    p = L.Profiles({"a": [1, 2, 3], "b": [3, 9]}, 3)
    import numpy as np

    own = L.ranked(np.array([1, 3, 5]), np.array([4, 4, 9]), 3)
    assert own.tolist() == [5, 1, 3]
    # 5 is unknown (3), 1 is one place off (1), 3 is at its place (0); b has only 3, two places off.
    assert p.distances(own).tolist() == [4 / 9, 8 / 9]


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus() + [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 ...", "de", "s", 0), (1003, "the thing " * 200_000, None, None, None), (None, "über straße nicht", "de", None, None)]
    table = with_clashes(spark.createDataFrame(rows, DOCS), "id", "lid_lang", "lang_pred", "score")
    found = {r["doc_id"]: r for r in L.identify(table, train_docs=20).collect()}
    assert len(found) == len(rows)
    held = [r for r in rows if found[r[0]]["held_out"] and r[0] is not None and r[0] < 1000]
    assert held and all(found[r[0]]["lang_pred"] == r[2] for r in held)
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_identified_keeps_clean_documents(spark):
    rows = corpus(60) + [(1000, None, "en", "s", 0), (1001, "42 !!", "en", "s", 0), (1002, "щзж", "en", "s", 0), (1003, "a", "en", "s", 0)]
    table = with_clashes(spark.createDataFrame(rows, DOCS), "lid_lang", "lid_distance")
    kept = L.identified(table)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not {1000, 1001} & ids and 1003 in ids


def test_empty_table(spark):
    assert L.identify(docs(spark, [])).collect() == []
    assert L.identified(docs(spark, [])).collect() == []
    assert [r["lang_pred"] for r in L.identify(spark.createDataFrame([(1, "text", None, None, 0)], DOCS)).collect()] == ["und"]
