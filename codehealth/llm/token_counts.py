"""Token counts by dynamic programming over prefixes.

The tokenizer is a byte-level BPE whose last symbol of a word carries an end mark.
Within a word the encoding of a prefix is the encoding of a shorter prefix plus one last
token, and two neighbouring tokens fit exactly if encoding their joined symbols gives the
same two again. So one pass over a word's prefixes finds the last token, and with it the
count, of every prefix. Words don't interact, so a text's prefix table is the running
sum over its words; truncation and budget questions are lookups in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

LIMIT = 2048
#: Below this character all versions of the Unicode tables agree on what is a letter, a number or white space.
SETTLED = "\u0250"
#: Chunks and words whose counts a worker keeps, and the longest that is kept.
CACHE_WORDS, CACHE_CHARS = 500_000, 48


def settled(text: str) -> bool:
    """Whether all of it is below SETTLED: lower case and words are then the library's, and nothing composes."""
    return text.isascii() or max(text) < SETTLED


@cache
def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class PrefixCounter(dict):
    """Token counts of every prefix of words and texts; as a dict: of a white-space-free chunk, its token count."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.specials = set(special)
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(first["pattern"]["Regex"])
        self.splitter = pre_tokenizers.Split(Regex(first["pattern"]["Regex"]), first["behavior"].lower(), first["invert"])
        self.normalizer = Tokenizer.from_file(path).normalizer
        #: Plain and word-final tokens as symbol strings without the mark, by the number of symbols.
        self.plain = {t for t in self.vocab if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)] for t in self.vocab if t.endswith(self.end)}
        #: What the tokens end in: themselves and all their tails.
        self.plain_tails = {t[k:] for t in self.plain for k in range(len(t))}
        self.final_tails = {t[k:] for t in self.final for k in range(len(t))}
        #: Whether pairs of tokens fit, by whether the second is word-final.
        self.pairs: tuple[dict[tuple[str, str], bool], dict[tuple[str, str], bool]] = ({}, {})
        self.counts: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens that the merges give for these symbols."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and ranks[k] == best and self.rank.get((symbols[k], symbols[k + 1])) == best:
                    out.append(symbols[k] + symbols[k + 1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def fit(self, left: str, right: str, final: bool) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when their symbols are encoded together."""
        end = self.end if final else ""
        found = self.merged([*left, *right[:-1], right[-1] + end]) == [left, right + end]
        pairs = self.pairs[final]
        if len(pairs) >= CACHE_WORDS:
            pairs.clear()
        pairs[left, right] = found
        return found

    def ending(self, s: str, i: int, last: list[str], final: bool) -> int:
        """Where the last token of the first ``i`` symbols begins, -1 if no token ends there; ``last``: the last token of each shorter prefix."""
        tokens, tails, pairs = (self.final, self.final_tails, self.pairs[True]) if final else (self.plain, self.plain_tails, self.pairs[False])
        # Leftwards as long as some token ends like this; then the longest tokens first.
        j, begins = i - 1, []
        while j >= 0 and (t := s[j:i]) in tails:
            if t in tokens:
                begins.append(j)
            j -= 1
        for j in reversed(begins):
            if j == 0:
                return j
            if left := last[j]:
                t = s[j:i]
                found = pairs.get((left, t))
                if found is None:
                    found = self.fit(left, t, final)
                if found:
                    return j
        return -1

    def word(self, text: str, whole: bool = False) -> list[int]:
        """For each number of leading characters 1..len, the tokens of that prefix as a word; only the last if ``whole``."""
        if text.isascii() and text.isprintable():
            s, ends = text, range(1, len(text) + 1)
        else:
            spelled = ["".join([self.symbols[b] for b in c.encode()]) for c in text]
            s, ends = "".join(spelled), list(accumulate(map(len, spelled)))
        if whole and s in self.final:
            return [1]
        n = len(s)
        last, count = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1 - whole):
            j = self.ending(s, i, last, False)
            if j >= 0:
                last[i], count[i] = s[j:i], count[j] + 1
        return [count[self.ending(s, i, last, True)] + 1 for i in (ends[-1:] if whole else ends)]

    def word_total(self, text: str) -> int:
        """The tokens of the whole word."""
        found = self.counts.get(text)
        if found is None:
            found = self.word(text, True)[0]
            if len(text) <= CACHE_CHARS:
                if len(self.counts) >= CACHE_WORDS:
                    self.counts.clear()
                self.counts[text] = found
        return found

    def normalized(self, part: str) -> str:
        """The library's own normal form: its Unicode tables may be of another version than Python's."""
        return part.lower() if settled(part) else self.normalizer.normalize_str(part)

    def spans(self, part: str) -> list[tuple[int, int]]:
        """Begin and end of each word of a normalized text."""
        if settled(part):
            return [m.span() for m in self.split.finditer(part)]
        return [span for _, span in self.splitter.pre_tokenize_str(part)]

    def words(self, part: str) -> list[str]:
        if part.isascii() and part.isalpha():
            return [part]
        return self.split.findall(part) if settled(part) else [w for w, _ in self.splitter.pre_tokenize_str(part)]

    def __missing__(self, chunk: str) -> int:
        count = sum(map(self.word_total, self.words(chunk)))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = count
        return count

    def parts(self, text: str) -> Iterator[str]:
        """The text between special strings, normalized, and the special strings themselves."""
        if self.special is None or not self.special.search(text):
            yield self.normalized(text)
            return
        for part in self.special.split(text):
            if part:
                yield part if part in self.specials else self.normalized(part)

    def table(self, text: str) -> tuple[list[str], np.ndarray]:
        """The chunks in text order and the tokens up to the end of each: the prefix table, which needs no encoding to read."""
        found, counts = [], []
        for part in self.parts(text):
            if part in self.specials:
                found.append(part)
                counts.append(1)
            else:
                more = white_split(part)
                found += more
                counts += map(self.__getitem__, more)
        return found, np.cumsum(counts, dtype=np.int64)

    def chunks(self, text: str) -> list[tuple[str, int]]:
        """(chunk, tokens up to its end): the table's rows."""
        found, ends = self.table(text)
        return list(zip(found, ends.tolist()))

    def total(self, text: str) -> int:
        """The table's last entry."""
        ends = self.table(text)[1]
        return int(ends[-1]) if len(ends) else 0

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of the normalized text, from no character to all of them."""
        out, before = [0], 0
        for part in self.parts(text):
            if part in self.specials:
                # A cut inside the special string leaves ordinary characters.
                out += [before + self.total(part[:k]) for k in range(1, len(part))] + [before + 1]
                before += 1
                continue
            at = 0
            for begin, end in self.spans(part):
                out += [before] * (begin - at)
                w = part[begin:end]
                if len(w) > 1 and w[0] == "'" and w[1:].isalpha():
                    counts = [sum(map(self.word_total, self.words(w[:k]))) for k in range(1, len(w) + 1)]
                else:
                    counts = self.word(w)
                out += [before + c for c in counts]
                before, at = out[-1], end
            out += [before] * (len(part) - at)
        return np.array(out, np.int64)


WHITE = regex.compile(r"\s+")


def white_split(part: str) -> list[str]:
    """Pieces between white space; str.split() also splits at U+001C..1F, which are no white space to the tokenizer."""
    if any(c in part for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in WHITE.split(part) if x]
    return part.split()


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, prefix_tokens for every row and whole text.

    ``prefix_tokens`` is the text's prefix table: entry k counts the tokens up to the end
    of the k-th piece between white space (special strings are pieces of their own), so
    what fits a budget is a lookup, see ``fitting``. ``path``: the tokenizer's JSON file,
    at the same place on every executor. Null text counts as empty; repeated rows give
    repeated rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            ends = [table.table(t)[1] if t else np.zeros(0, np.int64) for t in batch.column(1).to_pylist()]
            n = [int(e[-1]) if len(e) else 0 for e in ends]
            sizes = np.cumsum([0, *map(len, ends)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)))
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), over, lists], ["id", "n_bytes", "n_tokens", "over_limit", "prefix_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, prefix_tokens array<long>").withColumnRenamed("id", id_col)


def fitting(prefix_tokens: Column, budget: int) -> Column:
    """How many of a text's leading pieces have at most ``budget`` tokens together."""
    return F.size(F.filter(prefix_tokens, lambda n: n <= budget))


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, prefix_tokens: the exact count at every prefix of the normalized text, for later truncation and budget lookups.

    Entry k counts the tokens of the first k characters; null text gives [0].
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                row = pa.array([table.prefixes(t or "").tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), row], ["id", "prefix_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, prefix_tokens array<long>").withColumnRenamed("id", id_col)


def truncated(prefix: np.ndarray, budget: int) -> int:
    """The most leading characters whose tokens stay within ``budget``."""
    return int(np.flatnonzero(prefix <= budget)[-1])
