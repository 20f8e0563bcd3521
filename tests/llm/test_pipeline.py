import random

import corpus_pipeline
from tests.llm.helpers import DOCS, sentence
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_near_dedup import brute_classes

ENGLISH = "the and thing other with house there never again should water light"
GERMAN = "der und ich über schön straße nicht wieder niemals sollte wasser licht"


def corpus():
    rng = random.Random(31)
    rows, n = [], 0
    items = [(k, sentence(rng, 20, ENGLISH)) for k in range(5)]
    for k in range(60):
        lang = "en" if k % 2 else "de"
        base = sentence(rng, rng.randrange(60, 120), ENGLISH if k % 2 else GERMAN).split()
        for c in range(1 + (k % 6 == 0) * 2):
            copy = list(base)
            if c == 2:
                copy[10] = "andersnow"
            if k % 10 == 3:
                copy[5:5] = items[k % 5][1].split()
            rows.append((n := n + 1, " ".join(copy), lang, "abc"[k % 3], 0))
    rows += [(500, None, "en", "a", 0), (501, "123 !", "en", "a", 0), (502, "", "en", "b", 0)]
    return rows, items


def brute(rows, items):
    """What is left before the mix."""
    kept = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for i, text in kept:
        best[text] = max(i, best.get(text, i))
    kept = [(i, t) for i, t in kept if best[t] == i]
    classes = brute_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i] == i]
    bad = {i for i, *_ in contained(kept, items)}
    return {i for i, _ in kept if i not in bad}


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    before = {r["doc_id"]: r for r in docs.collect()}
    assert set(before) == brute(rows, items)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(before) and len(out) == len({r["doc_id"] for r in out}) > 10
    for r in out:
        assert r["mix_taken"] == r["mix_copies"] * len(r["text"].split()) and 1 <= r["mix_copies"] <= 3
        assert r["text"] == before[r["doc_id"]]["text"]
