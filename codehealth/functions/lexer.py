"""Masking of comments and literals, line by line, with the state that a line leaves to the next.

Lines are strings of one character per byte (Latin-1), so offsets are byte offsets.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class State(NamedTuple):
    """What an unfinished line is inside of: nothing, a block comment, a triple quote, or a template."""

    inside: str = ""


START = State()
QUOTED = {q: re.compile(rf"{q}(?:\\.|[^\\{q}]|\\\Z)*{q}?", re.S) for q in "\"'"}
ENDS = {"/*": "*/", '"""': '"""', "'''": "'''", "`": "`"}
STARTS = {
    "python": re.compile(r"#|//|/\*|\"\"\"|'''|\"|'"),
    "javascript": re.compile(r"//|/\*|`|\"|'"),
    "": re.compile(r"//|/\*|\"|'"),
}
ZIG_STRING = re.compile(r"[ \t]*\\\\")
BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")


def dialect(lang: str) -> str:
    """The lexer's dialect of a language."""
    return {"python": "python", "javascript": "javascript", "typescript": "javascript", "zig": "zig"}.get(lang, "")


def spans(line: str, lang: str, state: State):
    """Yields (kind, text) for the line's parts: code, literal, comment or mark (an opened or running block comment); returns the new state."""
    at, inside = 0, state.inside
    starts = STARTS.get(lang, STARTS[""])
    if not inside and lang == "zig" and ZIG_STRING.match(line):
        yield "literal", line
        return START
    while at < len(line):
        if inside:
            end = line.find(ENDS[inside], at)
            stop = len(line) if end < 0 else end + len(ENDS[inside])
            yield ("running" if inside == "/*" else "literal"), line[at:stop]
            at, inside = stop, inside if end < 0 else ""
            continue
        m = starts.search(line, at)
        if m is None:
            yield "code", line[at:]
            break
        if m.start() > at:
            yield "code", line[at : m.start()]
        at, found = m.start(), m[0]
        if found in ("#", "//"):
            yield "comment", line[at:]
            break
        if found == "/*":
            yield "comment", found
            at, inside = at + 2, found
        elif found in ENDS:
            yield "literal", found
            at, inside = at + len(found), found
        else:
            text = QUOTED[found].match(line, at)[0]
            yield "literal", text
            at += len(text)
    return State(inside)


def masked(line: str, lang: str, state: State) -> tuple[str, State]:
    """The line with blanks for comments and literals, of the same length, and the state after it."""
    out, parts = [], spans(line, lang, state)
    while True:
        try:
            kind, text = next(parts)
        except StopIteration as stop:
            return "".join(out), stop.value
        out.append(text if kind == "code" else " " * len(text))


def condensed(lines: list[str], lang: str) -> str:
    """The lines' code and literals, white space and comments between them as one blank, without line ends."""
    out, last, state = [], "", START

    def blank() -> None:
        nonlocal last
        if last and last != " ":
            out.append(" ")
            last = " "

    for line in lines:
        parts = spans(line, lang, state)
        while True:
            try:
                kind, text = next(parts)
            except StopIteration as stop:
                state = stop.value
                break
            if kind == "literal":
                out.append(text)
                last = text[-1:] or last
            elif kind == "comment":
                blank()
            elif kind == "code":
                pieces = BLANKS.split(text)
                for k, piece in enumerate(pieces):
                    if k:
                        blank()
                    if piece:
                        out.append(piece)
                        last = piece[-1]
    return "".join(out)


class Masks:
    """A text's lines, their masks, and the state before each."""

    def __init__(self, lines: list[str], lang: str):
        self.lines, self.lang = lines, lang
        self.masks: list[str] = []
        self.before: list[State] = []
        state = START
        for line in lines:
            self.before.append(state)
            mask, state = masked(line, lang, state)
            self.masks.append(mask)

    def fresh(self, start: int):
        """Masks from line ``start`` (from 0) on, read as if the text began there."""
        if self.before[start] == START:
            yield from self.masks[start:]
            return
        state = START
        for k in range(start, len(self.lines)):
            mask, state = masked(self.lines[k], self.lang, state)
            yield mask
            # From here on both readings agree.
            if k + 1 < len(self.lines) and state == self.before[k + 1]:
                yield from self.masks[k + 1 :]
                return
