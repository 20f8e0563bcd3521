"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's own features and those of the lines before and after
it make its score, the chain's transition weights join neighbouring labels, and
forward-backward gives each line's marginal probability of being good. A document's
quality is the mean of its lines' marginals, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.llm.common import mixed, utf8
from codehealth.llm.language_id import remainder

#: Labelled documents that the field is fitted to, at most, and the most lines of one chain: of a longer text the first, middle and last so many are chains of their own.
TRAIN_DOCS, TRAIN_LINES = 4000, 128
THRESHOLD = 0.3
STEPS, RATE, L2 = 250, 0.05, 1e-4
#: Bytes that are looked at together.
SLICE = 1 << 21
KINDS = 8


def byte_kinds() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 blank, 4 sentence mark, 5 other mark, 6 beyond ASCII, 7 control."""
    out = np.full(256, 5, np.uint8)
    out[:32] = 7
    out[127] = 7
    for k, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " \t"), (4, ".,;:'\"-()?")):
        out[[ord(c) for c in chars]] = k
    out[128:] = 6
    return out


BYTE_KINDS = byte_kinds()
#: Own features of a line, and all that a line's score is made of: own, before, after, first, last, 1.
OWN = 15
ALL = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, each line's length, each text's number of lines); an empty text has one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    doc_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    lines = np.diff(np.concatenate([[0], np.searchsorted(ends, doc_ends) + 1]))
    counts = np.zeros((len(ends), KINDS + 4), np.int64)
    base = 0
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        line = np.cumsum(part == 10)
        own = line - (part == 10)
        kind = BYTE_KINDS[part]
        m = int(own[-1]) + 1
        counts[base : base + m, :KINDS] += np.bincount(own * KINDS + kind, minlength=m * KINDS).reshape(m, KINDS)
        counts[base : base + m, KINDS:] += word_counts(part, kind, own, m)
        base += int(line[-1])
    size = np.maximum(sizes, 1)[:, None]
    share = counts[:, :7] / size
    n_words = np.maximum(counts[:, KINDS], 1)
    x = np.empty((len(ends), OWN))
    x[:, :7] = share
    x[:, 7] = np.log1p(sizes) / 8
    x[:, 8] = np.minimum(sizes / n_words, 40) / 10
    x[:, 9] = np.minimum(counts[:, 5] / n_words, 4)
    x[:, 10] = np.minimum(counts[:, 4] / n_words, 2)
    x[:, 11] = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    x[:, 12:15] = counts[:, KINDS + 1 :] / n_words[:, None]
    return x, np.maximum(sizes, 1), lines


def word_counts(part: np.ndarray, kind: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
    """By line: words, words like the one before, words that the line had already, words without letter or digit."""
    solid = (kind != 3) & (kind != 7)
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    out = np.zeros((m, 4), np.int64)
    if not len(starts):
        return out
    where = own[starts]
    begun = np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(part))))])
    places = np.arange(len(part)) - begun
    with np.errstate(over="ignore"):
        signed = mixed((part.astype(np.uint64) << np.uint64(32)) + places.astype(np.uint64) + np.uint64(1)) * solid
        hashes = np.add.reduceat(signed, starts)
    out[:, 0] = np.bincount(where, minlength=m)
    again = (hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])
    out[:, 1] = np.bincount(where[1:][again], minlength=m)
    keys = np.unique((where.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    out[:, 2] = out[:, 0] - np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=m)
    text = np.add.reduceat(((kind < 3) | (kind == 6)).astype(np.int64), starts)
    out[:, 3] = np.bincount(where[text == 0], minlength=m)
    return out


def chained(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """All features: own ones, the neighbours' in the same text, whether a line is first or last, and 1."""
    out = np.zeros((len(x), ALL))
    out[:, :OWN] = x
    first = np.cumsum(lines) - lines
    last = first + lines - 1
    out[1:, OWN : 2 * OWN] = x[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = x[1:]
    out[last, 2 * OWN : 3 * OWN] = 0
    out[first, -3] = 1
    out[last, -2] = 1
    out[:, -1] = 1
    return out


class Chains:
    """Places of the lines of many texts by step, longest text first, so that a step handles all texts at once."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        self.first = (np.cumsum(lines) - lines)[self.order]
        self.steps = int(lines.max(initial=0))
        ascending = np.sort(lines)
        self.active = [len(lines) - int(np.searchsorted(ascending, t, "right")) for t in range(self.steps)]

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


def messages(e: np.ndarray, chains: Chains, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from the lines up to each one, and from those after it; ``t[i, j]``: weight of label j after i."""
    ahead, back = e.copy(), np.zeros(len(e))
    for k in range(1, chains.steps):
        now = chains.at(k)
        o = ahead[now - 1]
        ahead[now] = e[now] + np.logaddexp(o + t[1, 1], t[0, 1]) - np.logaddexp(o + t[1, 0], t[0, 0])
    for k in range(chains.steps - 1, 0, -1):
        now = chains.at(k)
        o = e[now] + back[now]
        back[now - 1] = np.logaddexp(o + t[1, 1], t[1, 0]) - np.logaddexp(o + t[0, 1], t[0, 0])
    return ahead, back


def long_messages(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``messages`` of one chain, in runs of the square root of its length that advance together.

    A run turns the odds before it into the odds after it by a matrix of two rows, so the
    runs' matrices come first, then the odds between runs, then those inside.
    """
    n = len(e)
    width = max(1, int(np.sqrt(n)))
    runs = -(-n // width)

    def forward(e: np.ndarray, t: np.ndarray) -> np.ndarray:
        # Lines that fill up the last run come after all others and change nothing before them.
        grid = np.zeros((runs, width))
        grid.ravel()[:n] = e
        # logs[r, i, j]: weight of label j at the end of what is done of run r, if the line before the run has label i.
        logs = np.broadcast_to(np.where(np.eye(2) > 0, 0.0, -np.inf), (runs, 2, 2)).copy()
        for k in range(width):
            logs = np.logaddexp(logs[:, :, :1] + t[0], logs[:, :, 1:] + t[1])
            logs[:, :, 1] += grid[:, k, None]
            logs -= logs.max(axis=(1, 2), keepdims=True)
        odds = np.zeros(runs)
        state = None
        for r in range(runs):
            if state is not None:
                odds[r] = state[1] - state[0]
            if state is None:
                first = np.array([0.0, grid[0, 0]])
                for k in range(1, width):
                    first = np.logaddexp(first[0] + t[0], first[1] + t[1])
                    first[1] += grid[0, k]
                    first -= first.max()
                state = first
            else:
                state = np.logaddexp(state[0] + logs[r, 0], state[1] + logs[r, 1])
                state -= state.max()
        out = np.zeros((runs, width))
        o = odds
        for k in range(width):
            step = np.logaddexp(o + t[1, 1], t[0, 1]) - np.logaddexp(o + t[1, 0], t[0, 0])
            if k == 0:
                step[0] = 0.0
            o = grid[:, k] + step
            out[:, k] = o
        return out.ravel()[:n]

    ahead = forward(e, t)
    turned = forward(e[::-1], t.T)[::-1]
    return ahead, turned - e


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Field:
    """Weights of the line scores and of the transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Each line's probability of being good; ``x`` are own features."""
        e = chained(x, lines) @ self.weights
        ahead, back = messages(e, Chains(lines), self.transitions)
        return sigmoid(ahead + back)

    def long_score(self, data: bytes, run: int = SLICE) -> float:
        """The score of one long text, whose lines' features are made in runs of about ``run`` bytes; what stays of a line is its score and length."""
        scores, sizes, at = [], [], 0
        while at <= len(data):
            end = data.find(b"\n", min(len(data), at + run))
            end = len(data) if end < 0 else end
            # One line more on either side, so that every line of the run has its neighbours.
            before = data.rfind(b"\n", 0, at - 1) + 1 if at else 0
            after = data.find(b"\n", end + 1) if end < len(data) else -1
            part = data[before : len(data) if after < 0 else after]
            x, size, _ = line_features([part])
            e = chained(x, np.array([len(x)]))
            a, b = int(at > 0), len(x) - int(end < len(data))
            e[:, -3:-1] = 0
            if not at:
                e[0, -3] = 1
            if end == len(data):
                e[-1, -2] = 1
            scores.append(e[a:b] @ self.weights)
            sizes.append(size[a:b])
            at = end + 1
        e, size = np.concatenate(scores), np.concatenate(sizes)
        ahead, back = long_messages(e, self.transitions)
        p = sigmoid(ahead + back)
        return float((p * size).sum() / size.sum())

    def scores(self, texts: list[bytes]) -> list[float]:
        if len(texts) == 1 and len(texts[0]) >= SLICE:
            return [self.long_score(texts[0])]
        x, size, lines = line_features(texts)
        p = self.marginals(x, lines) * size
        first = np.cumsum(lines) - lines
        return (np.add.reduceat(p, first) / np.add.reduceat(size, first)).tolist()


def fitted(x: np.ndarray, lines: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Field:
    """The field that best explains lines labelled ``good`` (by line, 0 or 1), by Adam on the regularised likelihood."""
    everything, chains = chained(x, lines), Chains(lines)
    now = np.concatenate([chains.at(k) for k in range(1, chains.steps)]) if chains.steps > 1 else np.zeros(0, np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[now - 1], good[now]), 1)
    theta = np.zeros(ALL + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(lines))
    # Each text counts once, however many lines it has.
    for step in range(1, steps + 1):
        w, t = theta[:ALL], theta[ALL:].reshape(2, 2)
        e = everything @ w
        ahead, back = messages(e, chains, t)
        grad = np.empty_like(theta)
        grad[:ALL] = everything.T @ (good - sigmoid(ahead + back))
        if len(now):
            left, right = ahead[now - 1], e[now] + back[now]
            pair = np.stack([t[0, 0] + 0 * left, t[0, 1] + right, t[1, 0] + left, t[1, 1] + left + right], 1)
            pair = np.exp(pair - pair.max(1, keepdims=True))
            pair /= pair.sum(1, keepdims=True)
            grad[ALL:] = seen.ravel() - pair.sum(0)
        else:
            grad[ALL:] = 0
        grad = grad / n - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:ALL], theta[ALL:].reshape(2, 2))


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of less than SLICE bytes; a longer text is alone, so that others don't shift its pieces."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) + 1 >= SLICE:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t) + 1
    if out:
        yield out


def chains_of(data: bytes, lines: int) -> list[bytes]:
    """The text, or of a text of more lines its first, middle and last ``lines``."""
    n = data.count(b"\n") + 1
    if n <= lines:
        return [data]
    found = data.split(b"\n")
    return [b"\n".join(found[a : a + lines]) for a in sorted({0, (n - lines) // 2, n - lines})]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Field:
    """The field fitted to at most ``train_docs`` labelled rows, by hash of the id, in chains of at most ``train_lines`` lines.

    A document's label is every line's label. Rows without a label of 0 or 1 are left
    out; without any labelled row the field is neutral and every score is 0.5.
    """
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("good")).where("l_id IS NOT NULL AND good IN (0, 1)")
    known = known.orderBy(F.xxhash64("l_id"), "l_id", "good").limit(train_docs)
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("data", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, good = [], []
            for data, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for part in chains_of(data.as_py(), train_lines):
                    x, _, _ = line_features([part])
                    out.append(x.astype(np.float32).tobytes())
                    good.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(good, pa.int32())], ["x", "good"])

    # At most TRAIN_DOCS ids, and three chains of a row; ids that repeat are cut off at as many rows.
    found = rows.mapInArrow(run, "x binary, good int").limit(3 * train_docs).collect()
    if not found:
        return Field(np.zeros(ALL), np.zeros((2, 2)))
    found.sort(key=lambda r: (bytes(r["x"]), r["good"]))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, OWN) for r in found]
    lines = np.array([len(p) for p in parts])
    good = np.repeat(np.array([r["good"] for r in found]), lines)
    return fitted(np.concatenate(parts).astype(float), lines, good)


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted of every row and whole text; null counts as empty, an empty text is one empty line.

    Repeated rows give repeated rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for part in slices([x.as_py() for x in batch.column(1)]) for s in field.scores(part)]
            good = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), good], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 5, held: int = 0, **options) -> DataFrame:
    """id, held_out, score, predicted of every row; learned from labels whose id's remainder modulo ``parts`` isn't ``held``."""
    field = learn(docs, labels.where(remainder(F.col(id_col), parts) != held), id_col, text_col, label_col, **options)
    found = scored(docs, field, id_col, text_col)
    return found.select(id_col, (remainder(F.col(id_col), parts) == held).alias("held_out"), "score", "predicted")
