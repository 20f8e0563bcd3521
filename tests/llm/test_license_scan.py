import pytest
from tests.llm.helpers import docs, with_clashes

from codehealth.llm import common
from codehealth.llm.license_scan import PHRASES, TEMPLATES, Scanner, compiled, license_scan, parsed

MIT = TEMPLATES["MIT"]


def labels(text: str) -> set:
    return {r[0] for r in Scanner(PHRASES, TEMPLATES).scan(text.encode())["runs"]}


def accepts(template: str, text: str) -> bool:
    found = [w for w in common.words(text.encode())]
    return compiled("x", template).accepts(found, 0) == len(found)


def test_optional_and_replaceable_regions():
    t = 'use <<beginOptional>>of it <<beginOptional>>all<<endOptional>><<endOptional>> by <<var;words="1-2">> is free, version <<var;match="[0-9]+">>'
    assert accepts(t, "Use by me is free version 3")
    assert accepts(t, "use of it, by you two is FREE (version 12)")
    assert accepts(t, "use of it all by me is free version 3")
    assert not accepts(t, "use all by me is free version 3")
    assert not accepts(t, "use by is free version 3")
    assert not accepts(t, "use by one two three is free version 3")
    assert not accepts(t, "use by me is free version three")


def test_mandatory_wording_must_match_exactly():
    text = " ".join(w.decode() for w in common.words(MIT.encode().replace(b'<<var;words="1-8">>', b"this software").replace(b"<<beginOptional>>", b" ").replace(b"<<endOptional>>", b" ")))
    assert "MIT" in labels("(c) 2020 me. " + text + " and more")
    assert "MIT" not in labels(text.replace("sublicense", "subvert"))


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""


def test_disclaimers_are_mandatory():
    assert labels(MIT_TEXT) == {"MIT"} and labels(ISC_TEXT) == {"ISC"}
    assert labels(MIT_TEXT.replace("THE AUTHORS OR\nCOPYRIGHT HOLDERS", "EXAMPLE INC.")) == {"MIT"}
    for text in (MIT_TEXT, ISC_TEXT):
        permission, disclaimer = text.split("THE SOFTWARE IS PROVIDED")
        assert labels(permission) == set()
        assert labels(permission + "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED" + disclaimer) == set()
        assert labels(text.replace("TORT", "COURT")) == set()


def filled(tree) -> list[str]:
    """The words of a template's tree, optional regions left out and replaceable ones filled."""
    out = []
    for part in tree:
        if isinstance(part, str):
            out.append(part)
        elif isinstance(part, tuple):
            out += ["4" if part[1] == "[1-4]" else "0"] if part[0] == "match" else ["someone"] * part[1]
    return out


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_one_changed_mandatory_word_is_refused(label):
    automaton, tree = compiled(label, TEMPLATES[label]), parsed(TEMPLATES[label])
    found = [w.encode() for w in filled(tree)]
    assert automaton.accepts(found, 0) == len(found)
    places = [k for k, w in enumerate(found) if w.decode() in {p for p in tree if isinstance(p, str)}]
    for k in places:
        assert not automaton.accepts([*found[:k], b"changed", *found[k + 1 :]], 0), found[k]
        if 0 < k < len(found) - 1 and found[k - 1] != b"someone" and found[k + 1] != b"someone":
            assert not automaton.accepts([*found[:k], *found[k + 1 :]], 0) or found[k] == found[k + 1], found[k]


def test_base_counts_against_brute_force(spark):
    texts = [
        None, "", "the MIT License and the mit--license, mit\nlicense", "Apache license, Version 2.0; licensed under the Apache License 2.0", "cc by cc by cc", "CC BY-NC 4.0",
        "gnu general public gnu general public license version 3", "mitlicense license mit", "naïve mit license", "word " * 300_000 + "mit license",
    ]
    table = with_clashes(docs(spark, list(enumerate(texts))), "id", "data", "labels", "score")
    for row in license_scan(table).collect():
        found = [w.decode() for w in common.words((texts[row["doc_id"]] or "").encode())]
        places, base = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(found)) if found[k : k + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        assert row["n_words"] == len(found)
        assert (row["n_base"], row["first_word"], row["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert row["base_labels"] == ",".join(sorted(base))
        assert base <= set(row["labels"].split(",")) | {""}
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"])


def test_pieces_change_nothing(monkeypatch):
    text = ("filler words here " * 40 + "this is under the mit license. " + "licensed under the apache license version 2.0 now ") * 5
    whole = Scanner(PHRASES, TEMPLATES).scan(text.encode())
    monkeypatch.setattr(common, "PIECE", 50)
    assert Scanner(PHRASES, TEMPLATES).scan(text.encode()) == whole
    assert len(whole["places"]) == 10 and whole["n_words"] == len(text.replace(".", " ").split())


def test_empty_table(spark):
    assert license_scan(docs(spark, [])).collect() == []
