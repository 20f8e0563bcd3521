import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import docs, with_clashes
from tokenizers import Tokenizer

from codehealth.llm.token_counts import PrefixCounter, fitting, prefix_tables, token_counts, truncated

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLE = PrefixCounter(PATH)


def library(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


TEXTS = [
    "", "it's don't 'tis ''s I'LL we've", "<|endoftext|> a<|startoftext|>b <|endoftext", "naïve Ünïcode İstanbul ΑΣ ﬁ é 漢字 12345 ½ ²٣ 😀👨‍👩‍👧", "x\x1cy\x00z \x85 ​﻿", "a" * 300,
    "!" * 100 + "'s'", "supercalifragilistic" * 9, "Tab\there\r\nand  there",
]


@pytest.mark.parametrize("text", TEXTS)
def test_totals(text):
    assert TABLE.total(text) == library(text)
    assert (TABLE.chunks(text) or [("", 0)])[-1][1] == library(text)


def test_totals_are_read_off_the_table(monkeypatch):
    found, ends = TABLE.table("the quick  brown fox")
    assert found == ["the", "quick", "brown", "fox"] and ends.tolist() == [library(" ".join(found[:k])) for k in range(1, 5)]
    monkeypatch.setattr(TABLE, "table", lambda text: (found, ends + 7))
    assert TABLE.total("the quick brown fox") == ends[-1] + 7


@given(st.text(st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_totals_of_any_text(text):
    assert TABLE.total(text) == library(text)


@given(st.text("ab'stre lvmd!9é ", max_size=30))
@settings(max_examples=150, deadline=None)
def test_every_prefix(text):
    counts = TABLE.prefixes(text)
    shown = TABLE.normalized(text)
    assert counts.tolist() == [library(shown[:k]) for k in range(len(shown) + 1)]


def test_every_letter_beyond_ascii():
    for first in range(0x80, 0x1FFFF, 0x400):
        text = " ".join(f"a{chr(c)}b1" for c in range(first, first + 0x400) if not 0xD800 <= c < 0xE000)
        ends = TABLE.table(text)[1]
        if not len(ends) or ends[-1] == library(text):
            continue
        raise AssertionError([hex(ord(x[1])) for x in text.split(" ") if len(x) > 1 and TABLE.total(x) != library(x)])


def test_every_settled_letter():
    for c in range(0x1, 0x260):
        for text in (f"a{chr(c)}b1", f"A{chr(c)} {chr(c)}{chr(c)}z", f"{chr(c)}'S"):
            assert TABLE.total(text) == library(text), (hex(c), text)


def test_long_words_of_few_letters():
    for text in ("ab" * 700, "the" * 500 + "é", "0x" + "deadBEEF" * 90, "-=" * 400):
        assert TABLE.total(text) == library(text)


def test_budgets_need_no_encoding():
    counts = TABLE.prefixes("the quick brown fox jumps")
    assert truncated(counts, 0) == 0
    assert library("the quick brown fox jumps"[: truncated(counts, 3)]) <= 3
    assert truncated(counts, 100) == len("the quick brown fox jumps")


def test_query(spark):
    texts = [None, *TEXTS, "word " * 3000, "the " * 200_000]
    table = with_clashes(docs(spark, list(enumerate(texts))), "id", "n_bytes", "n_tokens")
    rows = {r["doc_id"]: r for r in token_counts(table, PATH).collect()}
    for k, t in enumerate(texts):
        n = library(t or "")
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
        assert (rows[k]["prefix_tokens"] or [0])[-1] == n and rows[k]["prefix_tokens"] == sorted(rows[k]["prefix_tokens"])
    some = token_counts(docs(spark, [(1, "the quick  brown fox")]), PATH).select(fitting(F.col("prefix_tokens"), 3).alias("n"), "prefix_tokens").first()
    assert some["prefix_tokens"] == [library(x) for x in ("the", "the quick", "the quick brown", "the quick brown fox")] and some["n"] == sum(x <= 3 for x in some["prefix_tokens"])
    assert token_counts(docs(spark, []), PATH).collect() == []
    some = prefix_tables(docs(spark, [(1, "It's"), (2, None)]), PATH).collect()
    assert {r["doc_id"]: r["prefix_tokens"] for r in some} == {1: [library("it's"[:k]) for k in range(5)], 2: [0]}
