from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.helpers import docs, with_clashes

from codehealth.llm.exact_dedup import dedup, dedup_classes

ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a b "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "y"), (9, "y"), (None, "z"), (None, "q"), (10, "q")]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


def test_matches_brute_force_with_nulls_ties_repeats_and_long_texts(spark):
    table = with_clashes(docs(spark, ROWS), "id", "content", "digest", "keep_id", "salt", "group_size")
    assert got(dedup_classes(table)) == brute(ROWS)


def test_different_texts_of_one_digest_stay_apart(spark):
    weak = lambda text: F.length(text).cast("string")
    rows = [(k, f"t{k % 7}") for k in range(60)] + [(100, "u1"), (101, "u1")]
    assert got(dedup_classes(docs(spark, rows), digest=weak)) == brute(rows)


def test_empty_table(spark):
    assert dedup_classes(docs(spark, [])).collect() == []
    assert dedup(docs(spark, [])).collect() == []


def test_dedup_keeps_columns_and_one_of_each_text(spark):
    table = with_clashes(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)]), "__id")
    kept = dedup(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_plan_has_no_python(spark):
    plan = dedup_classes(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
