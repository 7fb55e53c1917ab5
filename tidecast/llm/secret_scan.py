"""Secrets in texts: fixed patterns, and formats learned from what the patterns find.

The formats are probabilistic automata. The letters of a labelled credential become classes, the
credentials of one kind form a prefix tree, and states of the tree whose futures agree statistically
are merged, which leaves a small automaton with loops. A candidate is scored by its likelihood under
each automaton against its likelihood by how classes follow each other in all other text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.text_batches import slices, texts_of
from tidecast.sources.tables import staged

# The base patterns, and the lengths below which a match is dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "learned")

# What a text must contain to have a match at all; a fast first look at whole batches.
SIGNS = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    r"AKIA[A-Z0-9]{16}",
    r"[0-9a-f]{24}",
    r"[0-9][A-Za-z0-9+/_=-]{8}|[A-Za-z0-9+/_=-]{8}[0-9]",
)

# Candidates: runs of these letters with a digit among them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT = re.compile(r"[0-9]")
EXAMPLES_PER_KIND = 400
EXAMPLE_LETTERS = 48
MERGE_ALPHA = 0.02
FLOOR = math.log(1e-4)
MIN_GAIN = 1.0  # nats per letter

GROUPS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", "=")
CLASS_OF = {letter: k for k, group in enumerate(GROUPS) for letter in group}
CLASS_OF_BYTE = np.full(256, len(GROUPS), dtype=np.uint8)
for _letter, _class in CLASS_OF.items():
    CLASS_OF_BYTE[ord(_letter)] = _class
END = len(GROUPS)
MOVES_BYTES = 256 << 10  # moves are counted in pieces of so many bytes, since each byte of text takes several


def base_matches(text: str, signs: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base matches in code points, by start, then kind."""
    found = []
    if signs[0]:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                found.append((m.start(), 0, m.end(), m[2]))
    for kind, pattern, length in ((1, ACCESS, ACCESS_LENGTH), (2, HEX, HEX_LENGTH)):
        if signs[kind]:
            found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text) if len(m[0]) >= length]
    return sorted(found)


def signs_of(column: pa.Array) -> list[np.ndarray]:
    column = pc.fill_null(column, "")
    return [pc.match_substring_regex(column, sign).to_numpy(zero_copy_only=False) for sign in SIGNS]


class Automaton:
    """A deterministic probabilistic automaton: counts of moves and ends for each state."""

    def __init__(self, words: list[list[int]]):
        """The prefix tree of the words."""
        self.moves: list[dict[int, int]] = [{}]  # class -> next state
        self.counts: list[dict[int, int]] = [{}]  # class or END -> times
        for word in words:
            state = 0
            for c in word:
                self.counts[state][c] = self.counts[state].get(c, 0) + 1
                if c not in self.moves[state]:
                    self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    self.counts.append({})
                state = self.moves[state][c]
            self.counts[state][END] = self.counts[state].get(END, 0) + 1

    def agree(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding's test on the shares of every move, here and in all states that follow."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            n, m = sum(self.counts[a].values()), sum(self.counts[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in {*self.counts[a], *self.counts[b]}:
                if abs(self.counts[a].get(c, 0) / n - self.counts[b].get(c, 0) / m) > bound:
                    return False
            pending += [(self.moves[a][c], self.moves[b][c]) for c in self.moves[a] if c in self.moves[b]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
            for c, after in self.moves[b].items():
                if c in self.moves[a]:
                    pending.append((self.moves[a][c], after))
                else:
                    self.moves[a][c] = after

    def merged(self, alpha: float) -> Automaton:
        """Merge states in the order in which they are met from the start."""
        red, at = [0], 0
        while at < len(red):
            state = red[at]
            for c in sorted(self.moves[state]):
                blue = self.moves[state][c]
                if blue in red:
                    continue
                for other in red:
                    if self.agree(other, blue, alpha):
                        self.moves[state][c] = other
                        self.fold(other, blue)
                        break
                else:
                    red.append(blue)
            at += 1
            if at == len(red) and any(n not in red for s in red for n in self.moves[s].values()):
                at = 0  # folding gave an earlier state a new move
        return self

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state (-1: none) and log-probability of each class in each reachable state; END ends."""
        order, index = [0], {0: 0}
        for state in order:
            for after in self.moves[state].values():
                if after not in index:
                    index[after] = len(order)
                    order.append(after)
        after = np.full((len(order), END), -1)
        logs = np.full((len(order), END + 1), FLOOR)
        for i, state in enumerate(order):
            total = sum(self.counts[state].values())
            for c, n in self.counts[state].items():
                logs[i, c] = max(FLOOR, math.log(n / total))
            for c, to in self.moves[state].items():
                after[i, c] = index[to]
        return after, logs


class Formats:
    """What candidates are scored with: an automaton for each kind, and the ordinary moves of all texts."""

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray]], ordinary: np.ndarray, min_gain: float):
        self.automata, self.ordinary, self.min_gain = automata, ordinary, min_gain

    def gain(self, word: str) -> float:
        """Log-likelihood per letter of the best format over that of ordinary text."""
        classes = [CLASS_OF[c] for c in word]
        ordinary = sum(self.ordinary[a, b] for a, b in zip([END, *classes], classes))
        best = -math.inf
        for after, logs in self.automata:
            state, total = 0, 0.0
            for c in classes:
                total += logs[state, c]
                state = max(after[state, c], 0)
            best = max(best, total)
        return (best - ordinary) / len(word)

    def spans(self, text: str, signs=(True, True, True, True)) -> list[tuple[int, int, int]]:
        """(start, kind, end) of base matches and of learned ones clear of them, by start, then kind."""
        base = [m[:3] for m in base_matches(text, signs[:3])]
        more = []
        if signs[3] and self.automata:
            for m in CANDIDATE.finditer(text):
                if DIGIT.search(m[0]) and not any(s < m.end() and m.start() < e for s, _, e in base):
                    if self.gain(m[0]) >= self.min_gain:
                        more.append((m.start(), 3, m.end()))
        return sorted(base + more)


def moves_in(data: np.ndarray, limit: int = MOVES_BYTES) -> np.ndarray:
    """How often each class follows another in these bytes."""
    moves = np.zeros((END + 1) ** 2, dtype=np.int64)
    for start in range(0, len(data) - 1, limit):
        classes = CLASS_OF_BYTE[data[start : start + limit + 1]]  # with the first byte of the next piece
        moves += np.bincount(classes[:-1] * np.uint8(END + 1) + classes[1:], minlength=len(moves))
    return moves


def corpus_counts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """All base secrets with their kinds, and how often each class follows another in all other text."""

    def scan(batches):
        moves = np.zeros((END + 1) ** 2, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column("text")
                moves += moves_in(texts_of(column).data)
                *signs, _ = signs_of(column)
                rows = []
                for i in np.flatnonzero(signs[0] | signs[1] | signs[2]):
                    found = base_matches(column[int(i)].as_py(), tuple(bool(s[i]) for s in signs))
                    rows += {(kind, secret, None, None) for _, kind, _, secret in found}
                    at = 0
                    for start, _, end, _ in found:  # secrets are not ordinary text
                        inside = column[int(i)].as_py()[max(at, start) : end].encode()
                        moves -= moves_in(np.frombuffer(inside, dtype=np.uint8))
                        at = max(at, end)
                yield as_batch(rows)
        yield as_batch([(None, None, i, int(n)) for i, n in enumerate(moves) if n])

    def as_batch(rows):
        types = (pa.int32(), pa.string(), pa.int32(), pa.int64())
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["kind", "secret", "move", "times"]
        )

    text = docs.select(F.col("text").cast("string").alias("text"))
    found = staged(text.mapInArrow(scan, "kind int, secret string, move int, times long"), "secrets")
    moves = np.ones((END + 1) ** 2)
    for row in found.filter("move is not null").groupBy("move").agg(F.sum("times").alias("times")).collect():
        moves[row["move"]] += max(0, row["times"])
    return found.filter("kind is not null").select("kind", "secret"), moves.reshape(END + 1, END + 1)


def learn_formats(docs: DataFrame, examples: int = EXAMPLES_PER_KIND, min_gain: float = MIN_GAIN) -> Formats:
    """Infer one automaton for each base kind from at most `examples` different secrets, chosen by hash.

    The moves of ordinary text are counted over all texts.
    """
    secrets, moves = corpus_counts(docs)
    automata = []
    for kind in range(3):
        drawn = secrets.filter(F.col("kind") == kind).select("secret", F.xxhash64("secret").alias("draw")).distinct()
        words = [r["secret"] for r in drawn.orderBy("draw", "secret").limit(examples).collect()]
        words = [[CLASS_OF[c] for c in w[:EXAMPLE_LETTERS] if c in CLASS_OF] for w in words]
        if words:
            automata.append(Automaton(words).merged(MERGE_ALPHA).table())
    return Formats(automata, np.log(moves / moves.sum(axis=1, keepdims=True)), min_gain)


def secret_spans(docs: DataFrame, formats: Formats, text: str = "text") -> Column:
    """A column of spans, array<struct<kind, start, end>>, in code points with the end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast((formats.automata, formats.ordinary, formats.min_gain))

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(column: pa.Array) -> pa.Array:
        known, signs = Formats(*shared.value), signs_of(column)
        found = [[]] * len(column)
        for i in np.flatnonzero(signs[0] | signs[1] | signs[2] | signs[3]):
            seen = known.spans(column[int(i)].as_py(), tuple(bool(s[i]) for s in signs))
            found[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in seen]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(found, pa.list_(kind))

    return spans(F.col(text).cast("string"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every text: doc_id, spans array<struct<kind, start, end>>.

    Kinds are the base ones, assign, access and hex, whose matches always stay, and "learned" for runs of
    letters with a digit that fit a learned format much better than ordinary text and touch no base match.
    A null or empty text has no spans. Texts without base matches anywhere leave nothing to learn, and
    only base matches are given. Repeated rows get equal results. An empty table gives no rows. Other
    columns are ignored.
    """
    return docs.select("doc_id", secret_spans(docs, learn_formats(docs)).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; spans that overlap share one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, span: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        shown = F.when(span["start"] >= state["at"], F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), shown.alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows, with their columns; secrets in texts are replaced by a mark, and n_chars follows."""
    found = docs.withColumn("_spans", secret_spans(docs, learn_formats(docs)))
    shown = found.withColumn("text", redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        shown = shown.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return shown.select(*docs.columns)
