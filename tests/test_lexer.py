import pytest

from codehealth.functions.lexer import START, Masks, State, condensed, masked

LINES = ["a = 'x' + \"y\\\"z\" // c", "/* open", "still */ f(`t ${x}", "y`) # end", '"""doc', "'' ''' \"\"\" x", "\t\\\\ zig {", "end \\", "'unclosed", ""]


@pytest.mark.parametrize("lang", ["python", "javascript", "zig", "rust", "go", "c", "other"])
def test_masks_keep_lengths(lang):
    state = START
    for line in LINES:
        mask, state = masked(line, lang, state)
        assert len(mask) == len(line) and all(m in (" ", c) for m, c in zip(mask, line))


def test_literals_and_comments_are_blank():
    assert masked("f('(') // {", "c", START)[0] == "f(   )" + " " * 5
    assert masked("x # {", "python", START)[0] == "x    " and masked("x # {", "rust", START)[0] == "x # {"
    assert masked("  \\\\ raw {", "zig", START)[0] == " " * 10
    assert masked("fn f<'a>(x)", "rust", START)[0] == "fn f<" + " " * 6


def test_state_goes_on():
    assert masked("a /* b", "go", START) == ("a     ", State("/*"))
    assert masked("c */ d", "go", State("/*")) == ("     d", START)
    assert masked("x = '''a", "python", START)[1] == State("'''")
    assert masked("`a", "javascript", START)[1] == State("`") and masked("`a", "zig", START) == ("`a", START)


def test_condensed_text():
    assert condensed(["  return  a; // one", "", "\tb('x  y') /* two", "three */ + c"], "javascript") == "return a; b('x  y') + c"


def test_fresh_reading_forgets_the_state():
    masks = Masks(["x = `open", "fn { `", "end }"], "javascript")
    assert list(masks.fresh(0)) == masks.masks
    assert list(masks.fresh(1)) == ["fn {  ", "     "]
