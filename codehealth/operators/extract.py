"""What one source file declares and uses: imports, functions, classes, calls, mentions, bodies.

Works on lines of one character per byte. Declarations are found on masked lines, where
comments and literals are blank, by one pattern per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from codehealth.functions.lexer import START, Masks, condensed, dialect, masked
from codehealth.functions.paths import is_test

ID = r"[A-Za-z0-9_]+"
END = r"(?![A-Za-z0-9_])"
WORD = re.compile(ID)
CALL = re.compile(rf"({ID})[ \t]*\(")
BREAKS = r" \t\r\n(),{}\[\];"
BRANCH = re.compile(rf"(?<![^{BREAKS}])(?:if|for|while|case|catch|except|elif|elsif)(?![^{BREAKS}])")
BOOLEAN_WORD = re.compile(rf"(?<![^{BREAKS}])(?:and|or)(?![^{BREAKS}])")
BOOLEAN_MARK = re.compile(r"&&|\|\|")

# Names before a parenthesis that are no calls.
NO_CALLS = frozenset(
    "if while for switch catch return fn match loop unsafe as elif def class lambda print function go defer func sizeof".split()
)
C_KEYWORDS = frozenset("if for while switch return sizeof defined".split())
C_NO_FUNCTION = ("#", "typedef", "using", "class ", "struct ", "enum ", "return ", "if", "for", "while", "switch")

TEST_BLOCK = re.compile(r'test "|test\{|test\(|it\(|describe\(|def test_|func Test')
BODY_BYTES = 20
MOST_BASES = 8


@dataclass
class Function:
    name: str
    start: int
    end: int
    cyclomatic: int
    cognitive: int
    params: int
    public: bool
    method: bool


@dataclass
class Class:
    name: str
    bases: list[str]
    kind: str


@dataclass
class Extract:
    imports: list[str] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    #: (line, callee, qualified, first declared enclosing function's place or None)
    calls: list[tuple[int, str, bool, int | None]] = field(default_factory=list)
    #: (name, first mention is in a test block, any in production code, any in a test block)
    mentions: list[tuple[str, bool, bool, bool]] = field(default_factory=list)
    #: (smallest enclosing function's place or None, callee)
    local_calls: list[tuple[int | None, str]] = field(default_factory=list)
    #: (function's place, condensed body)
    bodies: list[tuple[int, str]] = field(default_factory=list)


# Functions.

FUNCTION = {
    "zig": re.compile(rf"(?P<pub>pub )?(?P<mods>(?:export |inline )*)fn [ \t]*(?P<name>{ID})[ \t]*\("),
    "rust": re.compile(
        rf"(?P<pub>pub (?:\([^)]*\) *)?|pub\([^)]*\) *)?(?:async )?(?:const )?(?:unsafe )?fn [ \t]*(?P<name>{ID})[ \t]*(?:<[^>]*>[ \t]*)?(?P<rest>\(.*)", re.S
    ),
    "python": re.compile(rf"(?:async )?def [ \t]*(?P<name>{ID})[ \t]*\("),
    "javascript": re.compile(rf"(?P<pub>export default |export )? *(?:async )?function(?:\* *| +)[ \t]*(?P<name>{ID})[ \t]*(?:<[^>]*>[ \t]*)?\("),
    "go": re.compile(rf"func (?:(?P<receiver>\([^)]*\))[ \t]*|[ \t]*)(?P<name>{ID})[ \t]*\("),
}
FUNCTION["typescript"] = FUNCTION["javascript"]
C_HEAD = re.compile(rf"[^(]*?(?P<name>{ID})[ \t]*\(")
C_TAIL = re.compile(r"\)[ \t]*\{[^)]*\Z")


def declared(line: str, lang: str) -> tuple[int, str, bool, bool] | None:
    """(offset, name, public, method) of the function that a trimmed masked line declares."""
    if lang in ("c", "cpp"):
        m = C_HEAD.match(line)
        if m is None or line.startswith(C_NO_FUNCTION) or m["name"] in C_KEYWORDS or not C_TAIL.search(line, m.end()):
            return None
        return m.start("name"), m["name"], not line.startswith("static "), False
    m = FUNCTION[lang].match(line) if lang in FUNCTION else None
    if m is None:
        return None
    public, method = False, False
    if lang == "zig":
        public = bool(m["pub"]) or "export " in m["mods"]
    elif lang == "rust":
        public, method = bool(m["pub"]), "&self" in m["rest"] or "self: " in m["rest"]
    elif lang in ("javascript", "typescript"):
        public = bool(m["pub"])
    elif lang == "go":
        public, method = "A" <= m["name"][0] <= "Z", bool(m["receiver"])
    return m.start("name"), m["name"], public, method


def indent(line: str) -> int:
    """Width of the leading blanks, a tab counting four."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def parameters(line: str, start: int = 0) -> int:
    """Parameters of the first parenthesis group from ``start`` on, receivers left out; 0 where it doesn't close on the line."""
    at = line.find("(", start)
    if at < 0:
        return 0
    level, stop = 0, None
    for k in range(at, len(line)):
        level += (line[k] == "(") - (line[k] == ")")
        if level == 0:
            stop = k
            break
    if stop is None:
        return 0
    parts, level, begin = [], 0, at + 1
    for k in range(at + 1, stop):
        c = line[k]
        if c == "," and level == 0:
            parts.append(line[begin:k])
            begin = k + 1
        elif c in "([{":
            level += 1
        elif c in ")]}" and level:
            level -= 1
    parts.append(line[begin:stop])
    return sum(1 for p in parts if p.strip(" \t") and not RECEIVER.match(p.strip(" \t")))


RECEIVER = re.compile(r"(?:&[ \t]*)?(?:mut [ \t]*)?(?:self|this)(?::|\Z)")


def body_end(masks: Masks, start: int, lang: str) -> int:
    """The last line (from 0) of the function declared on line ``start``."""
    lines = masks.lines
    if lang == "python":
        own, last = indent(lines[start]), start
        for k in range(start + 1, len(lines)):
            if not lines[k].strip(" \t\r"):
                continue
            if indent(lines[k]) <= own:
                break
            last = k
        return last
    level, opened = 0, False
    for k, mask in enumerate(masks.fresh(start), start):
        for c in BRACE.findall(mask):
            if c == "{":
                level, opened = level + 1, True
            else:
                level -= 1
                if opened and level <= 0:
                    return k
    return len(lines) - 1


BRACE = re.compile(r"[{}]")


def complexity(masks: Masks, start: int, end: int, lang: str) -> tuple[int, int]:
    """(cyclomatic, cognitive) of lines ``start`` to ``end``."""
    cyclomatic, cognitive, nesting = 1, 0, 0
    for k, mask in zip(range(start, end + 1), masks.fresh(start)):
        branches = len(BRANCH.findall(mask))
        joins = len(BOOLEAN_MARK.findall(mask)) + len(BOOLEAN_WORD.findall(mask))
        cyclomatic += branches + joins
        cognitive += branches * (nesting + 1) + joins
        if lang == "python":
            nesting = indent(masks.lines[k]) // 4
        else:
            nesting = max(0, nesting + mask.count("{") - mask.count("}"))
            if k == start and nesting:
                nesting -= 1
    return cyclomatic, cognitive


def functions(masks: Masks, lang: str, strict: bool = True) -> list[Function]:
    """Functions in the order of their declarations.

    ``strict`` keeps three quirks: a name is cut from the raw line at its offset in the
    trimmed mask, parameters are those of the line's first parenthesis, and masked
    string literals hide Rust's extern functions.
    """
    out = []
    for k, mask in enumerate(masks.masks):
        line = mask.strip(" \t\r")
        found = declared(line if strict else re.sub(r"^((?:pub |unsafe )*)extern +(?=fn )", r"\1", line), lang)
        if found is None:
            continue
        offset, name, public, method = found
        raw = masks.lines[k]
        if strict:
            at = len(raw) - len(raw.lstrip(" \t")) + offset
            if at + len(name) > len(raw):
                continue
        else:
            at = mask.find(name, len(mask) - len(mask.lstrip(" \t\r")))
        end = body_end(masks, k, lang)
        cyclomatic, cognitive = complexity(masks, k, end, lang)
        params = parameters(raw, 0 if strict else at)
        if lang == "python":
            method = indent(raw) > 0
        out.append(Function(raw[at : at + len(name)], k + 1, end + 1, cyclomatic, cognitive, params, public, method))
    return out


# Classes.

PY_CLASS = re.compile(rf"class [ \t]*({ID})")
RUST_ITEM = re.compile(rf"(?:pub )?(?:pub\([^)]*\) *)?(?:(trait|struct|enum) [ \t]*({ID})|impl(?=[ <]))")
JS_CLASS = re.compile(rf"(?:(?:export default|export declare|export abstract|export|default|declare|abstract|final) )*class [ \t]*({ID})")
CPP_CLASS = re.compile(r"(class|struct) ")
ZIG_TYPE = re.compile(rf"(?:pub )?const [ \t]*({ID}){END}[ \t=]*(struct|union|enum|error)")
GO_TYPE = re.compile(rf"type [ \t]*({ID}){END}[ \t]*(struct|interface)")
TYPE_NAME = re.compile(rf"(?:{ID}::)*({ID})(?![A-Za-z0-9_]|::)")
RUST_DECORATION = re.compile(r"(?:&[ \t]*|'[a-z_]*[ \t]*|mut |dyn )*")
ACCESS = re.compile(r"(?:public +)?(?:protected +)?(?:private +)?(?:virtual +)?")


def angle_end(text: str, at: int) -> int | None:
    """The place after the > that closes the < at ``at``; the > of an arrow closes nothing."""
    level = 0
    for m in re.finditer(r"<|(?<!-)>", text[at:]):
        level += 1 if m[0] == "<" else -1
        if level == 0:
            return at + m.end()
    return None


def outside_angles(text: str, word: str) -> int:
    """The first place of ``word`` that isn't inside angle brackets, or -1."""
    level = 0
    for k, c in enumerate(text):
        if c == "<":
            level += 1
        elif c == ">" and text[k - 1 : k] != "-" and level:
            level -= 1
        if level == 0 and text.startswith(word, k):
            return k
    return -1


def trimmed(text: str, a: int, b: int, chars: str) -> tuple[int, int]:
    """The span a..b without ``chars`` at its ends."""
    a += len(text[a:b]) - len(text[a:b].lstrip(chars))
    return a, a + len(text[a:b].rstrip(chars))


def rust_name(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span of the last name of a type, without references, lifetimes and arguments."""
    a, b = trimmed(text, a, b, " \t")
    at = RUST_DECORATION.match(text, a, b).end()
    m = TYPE_NAME.match(text, at, b)
    return m.span(1) if m else None


def leaf(text: str, a: int, b: int) -> tuple[int, int]:
    """The part of a span after its last :: and then its last dot."""
    a = max(a, text.rfind("::", a, b) + 2) if "::" in text[a:b] else a
    return max(a, text.rfind(".", a, b) + 1), b


def class_spans(t: str, lang: str) -> tuple[str, tuple[int, int], list[tuple[int, int]]] | None:
    """(kind, span of the name, spans of the bases) that a trimmed masked line declares."""
    bases: list[tuple[int, int]] = []
    if lang == "python":
        if (m := PY_CLASS.match(t)) is None:
            return None
        if (opened := t.find("(", 6)) >= 0:
            if (closed := t.find(")", opened)) < 0:
                return None
            bases = [trimmed(t, *p, " \t") for p in pieces(t, opened + 1, closed) if "=" not in t[slice(*p)]]
        return "class", m.span(1), bases
    if lang == "rust":
        if (m := RUST_ITEM.match(t)) is None:
            return None
        if m[1]:
            return m[1], m.span(2), []
        at = m.end() + len(t[m.end() :]) - len(t[m.end() :].lstrip(" \t"))
        if t[at : at + 1] == "<" and (end := angle_end(t, at)) is not None:
            at = end + len(t[end:]) - len(t[end:].lstrip(" \t"))
        middle = outside_angles(t[at:], " for ")
        if middle < 0:
            own = rust_name(t, at, len(t))
            return ("struct", own, []) if own else None
        base, own = rust_name(t, at, at + middle), rust_name(t, at + middle + 5, len(t))
        return ("struct", own, [base]) if base and own else None
    if lang in ("javascript", "typescript"):
        if (m := JS_CLASS.match(t)) is None:
            return None
        after = t.index("class ", m.start()) + 6 if t.startswith("class ") else m.start(1)
        if (at := t.find(" extends ", after)) >= 0:
            stop = t.find(" implements", at + 9)
            bases.append(leaf(t, *trimmed(t, at + 9, stop if stop >= 0 else len(t), " \t{}")))
        if (at := t.find(" implements ", after)) >= 0:
            stop = t.find("{", at + 12)
            a, b = trimmed(t, at + 12, stop if stop >= 0 else len(t), " \t{")
            bases += [leaf(t, *trimmed(t, *p, " \t")) for p in pieces(t, a, b)]
        return "class", m.span(1), bases
    if lang == "cpp":
        if (m := CPP_CLASS.match(t)) is None or (n := TYPE_NAME.match(t, m.end())) is None:
            return None
        tail = n.end()
        if t[tail : tail + 1] == "<":
            tail = angle_end(t, tail) or tail
        colon, body = t.find(":", tail), t.find("{", tail)
        if colon >= 0 and (body < 0 or colon < body):
            for p in pieces(t, colon + 1, body if body >= 0 else len(t)):
                a, b = trimmed(t, *p, " \t")
                if base := TYPE_NAME.match(t, ACCESS.match(t, a, b).end(), b):
                    bases.append(base.span(1))
        return m[1], n.span(1), bases
    if lang == "zig" and (m := ZIG_TYPE.match(t)):
        return "struct" if m[2] in ("struct", "union") else "enum", m.span(1), []
    if lang == "go" and (m := GO_TYPE.match(t)):
        return m[2], m.span(1), []
    return None


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Spans between the commas of a span."""
    for part in text[a:b].split(","):
        yield a, a + len(part)
        a += len(part) + 1


def classes(masks: Masks, lang: str) -> list[Class]:
    """Classes and the like in the order of their declarations; names and bases as the raw lines have them."""
    out = []
    for raw, mask in zip(masks.lines, masks.masks):
        lead = len(mask) - len(mask.lstrip(" \t\r"))
        found = class_spans(mask.strip(" \t\r"), lang)
        if found:
            kind, (a, b), bases = found
            spans = [s for s in bases if s[0] < s[1]][:MOST_BASES]
            out.append(Class(raw[lead + a : lead + b], [raw[lead + x : lead + y] for x, y in spans], kind))
    return out


# Imports.

GO_ENTRY = re.compile(r'(?:[A-Za-z0-9_.*]+[ \t]*)?"([^"(]+)"')
QUOTE = r"""(?=(["'])(.*?)\1)"""
MARKS = {
    "zig": ("@import(",), "c": ("#include ",), "cpp": ("#include ",), "go": ("import ",),
    "javascript": (" from ", "import ", "require(", "import("), "typescript": (" from ", "import ", "require(", "import("),
}
MARKED = {m: re.compile(f"(?={re.escape(m)}{QUOTE})", re.S) for marks in MARKS.values() for m in marks}


def quoted(line: str, code: str, marks: tuple[str, ...]) -> str | None:
    """The quoted text right after the first mark that is code."""
    for mark in marks:
        for m in MARKED[mark].finditer(line):
            if code.startswith(mark, m.start()):
                return m[2]
    return None


def rust_import(line: str, code: str) -> str | None:
    m = re.match(r"(?:pub )?(use|mod) ", code)
    if m is None:
        return None
    rest = line[m.end() :].strip(" \t;")
    if " as " in rest:
        rest = rest.partition(" as ")[0].strip(" \t")
    if "{" in rest:
        rest = rest.partition("{")[0].rstrip(" \t:")
    return rest if m[1] == "use" or WORD.fullmatch(rest) else None


def python_imports(line: str, code: str) -> list[str]:
    if code.startswith("import "):
        parts = (p.strip(" \t;") for p in line[7:].strip(" \t;").split(","))
        return [p.partition(" as ")[0].strip(" \t") if " as " in p else p for p in parts]
    if code.startswith("from ") and (stop := code.find(" import ", 5)) >= 0:
        return [line[5:stop].strip(" \t")]
    return []


def imports(masks: Masks, lang: str) -> list[str]:
    """Distinct import texts in the order they are first seen."""
    out: dict[str, None] = {}
    inside = False
    for raw, mask in zip(masks.lines, masks.masks):
        if lang == "go":
            code = mask.strip(" \t\r")
            found = None
            if inside and code == ")":
                inside = False
            elif inside:
                m = GO_ENTRY.fullmatch(raw.strip(" \t\r"))
                found = m[1] if m else None
            elif code.startswith("import") and "(" in code:
                inside = True
            else:
                found = quoted(raw, mask, MARKS["go"])
            if found:
                out.setdefault(found)
            continue
        code = mask.lstrip(" \t\r")
        if not code or code[0] == "#" and lang not in ("c", "cpp"):
            continue
        line = raw[len(mask) - len(code) :]
        if lang == "python":
            more = python_imports(line, code)
        elif lang == "rust":
            more = [rust_import(line, code)]
        else:
            more = [quoted(line, code, MARKS[lang])] if lang in MARKS else []
        for m in more:
            if m:
                out.setdefault(m)
    return list(out)


# Calls, mentions and bodies.


def calls(masks: Masks, found: list[Function]) -> list[tuple[int, str, bool, int | None]]:
    starts = {f.start for f in found}
    out = []
    for line, (raw, mask) in enumerate(zip(masks.lines, masks.masks), 1):
        if line in starts:
            continue
        for m in CALL.finditer(mask):
            a, b = m.span(1)
            qualified = mask[a - 1 : a] in (".", ":") if a else False
            if qualified or raw[a:b] not in NO_CALLS:
                first = next((k for k, f in enumerate(found) if f.start <= line <= f.end), None)
                out.append((line, raw[a:b], qualified, first))
    return out


class TestBlocks:
    """Whether lines are in a test block: from a line that opens one to the next that is indented no more."""

    def __init__(self) -> None:
        self.indent: int | None = None

    def holds(self, line: str) -> bool:
        text = line.strip(" \t\r")
        lead = len(line) - len(line.lstrip(" \t"))
        opens = TEST_BLOCK.match(text) is not None
        if self.indent is not None and text and lead <= self.indent and not opens:
            self.indent = None
        if self.indent is None and opens:
            self.indent = lead
        return self.indent is not None


def uses(lines: list[str], path: str, found: list[Function], result: Extract) -> None:
    """Mentions, local calls and bodies, read as Python or else as JavaScript."""
    lang = "python" if path.endswith(".py") else "javascript"
    starts = {f.start for f in found}
    names: dict[str, list[bool]] = {}
    blocks, mention_state, call_state = TestBlocks(), START, START
    for line, raw in enumerate(lines, 1):
        test = blocks.holds(raw)
        if line in starts:
            continue
        mask, mention_state = masked(raw, lang, mention_state)
        for name in WORD.findall(mask):
            seen = names.setdefault(name, [test, False, False])
            seen[1 + test] = True
        if test:
            continue
        mask, call_state = masked(raw, lang, call_state)
        if "(" not in mask:
            continue
        around = [(f.end - f.start, k) for k, f in enumerate(found) if f.start <= line <= f.end]
        inner = min(around)[1] if around else None
        result.local_calls += [(inner, m[1]) for m in CALL.finditer(mask) if m[1] not in NO_CALLS]
    result.mentions = [(name, *flags) for name, flags in names.items()]
    for k, f in enumerate(found):
        alone = not any(j != k and f.start <= g.end and g.start <= f.end for j, g in enumerate(found))
        body = condensed(lines[f.start : f.end], lang) if alone else ""
        if len(body) >= BODY_BYTES:
            result.bodies.append((k, body))


def extract(path: str, content: bytes, lang: str, strict: bool = True) -> Extract:
    """All that is taken from one file; mentions, local calls and bodies only of files that aren't tests."""
    lines = content.decode("latin-1").split("\n")
    masks = Masks(lines, dialect(lang))
    out = Extract(imports(masks, lang), functions(masks, lang, strict), classes(masks, lang))
    out.calls = calls(masks, out.functions)
    if not is_test(path):
        uses(lines, path, out.functions, out)
    return out
