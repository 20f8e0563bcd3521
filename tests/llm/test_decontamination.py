import random

from tests.llm.helpers import docs, sentence, with_clashes

from codehealth.llm import common
from codehealth.llm.decontamination import contaminated, decontaminated


def runs(text, n):
    w = [x for x in common.words((text or "").encode())]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def brute(documents, items, share=0.8):
    out = []
    for i, text in documents:
        for j, item in items:
            n = min(5, len(common.words((item or "").encode())))
            want = runs(item, n)
            shared = len(want & runs(text, n))
            if want and shared >= share * len(want):
                out.append((i, j, len(want), shared))
    return sorted(out, key=str)


def case():
    rng = random.Random(11)
    items = [(k, sentence(rng, rng.randrange(6, 60))) for k in range(30)] + [(100, None), (101, ""), (102, "two words"), (103, "..."), (104, items_word := "Lonely")]
    documents = []
    for k in range(60):
        parts = [sentence(rng, rng.randrange(1, 400))]
        if k % 3 == 0:
            words = items[k % 30][1].split()
            if k % 2:
                words[len(words) // 2] = "changed"
            parts += [" ".join(words), sentence(rng, 20)]
        documents.append((k, " ".join(parts)))
    documents += [(200, None), (201, ""), (202, "only TWO, words here"), (203, items_word), (203, items_word), (None, items[3][1]), (204, "filler " * 100_000 + items[4][1])]
    return documents, items


def test_against_brute_force(spark):
    documents, items = case()
    table = with_clashes(docs(spark, documents), "id", "item", "data", "item_id")
    tests = with_clashes(spark.createDataFrame(items, "item_id long, text string"), "id", "data", "doc_id")
    for block in (2_000_000, 100):
        got = contaminated(table, tests, block=block).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got), key=str) == brute(documents, items)
    assert len(brute(documents, items)) > 15


def test_decontaminated_drops_what_contains_an_item(spark):
    documents, items = case()
    table = with_clashes(docs(spark, documents), "__key")
    kept = decontaminated(table, spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, *_ in brute(documents, items)}
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in documents if i not in bad), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs(spark, [(1, "a")]), none).collect() == []
    assert contaminated(docs(spark, []), spark.createDataFrame([(1, "a b")], none.schema)).collect() == []
    assert decontaminated(docs(spark, [(1, "a")]), none).count() == 1
