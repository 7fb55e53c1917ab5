"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over bins, and some pairs of features have one over pairs of
bins. The tables are learned by cyclic boosting: in every round each feature in turn gets a small step
from a shallow tree on its own bins. A text's score is a sum of looked-up values.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.labelled import held_out, labelled_rows
from tidecast.llm.text_batches import Texts, binary_array, slices, texts_of, words_of

FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAF_WEIGHT = 5.0

FEATURES = (
    "log_words", "word_length", "symbol_share", "bar_share", "mark_share", "upper_share", "digit_share",
    "other_share", "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "stop_share",
)


def byte_set(letters: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(letters)] = True
    return found


SYMBOL, BAR, MARK, STOP = byte_set(b"#*$%&<>"), byte_set(b"|"), byte_set(b"!?"), byte_set(b".,;:")
UPPER, DIGIT = byte_set(bytes(range(0x41, 0x5B))), byte_set(bytes(range(0x30, 0x3A)))
LOWER = byte_set(bytes(range(0x61, 0x7B)))
HIGH = byte_set(bytes(range(0x80, 0x100)))


def features_of(texts: Texts) -> np.ndarray:
    """One row of features per text; all zero for a text without words."""
    data, n = texts.data, texts.count
    words = words_of(texts)
    n_words = np.bincount(words.doc, minlength=n).astype(float)
    per_word = np.maximum(n_words, 1)
    lengths = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))
    n_bytes = np.bincount(words.doc, lengths[words.ids] if len(words.ids) else None, n)
    per_byte = np.maximum(n_bytes, 1)
    count = {name: texts.per_text(found[data]) for name, found in
             (("symbol", SYMBOL), ("bar", BAR), ("mark", MARK), ("stop", STOP), ("upper", UPPER), ("digit", DIGIT), ("lower", LOWER), ("high", HIGH))}
    capital = np.zeros(len(data), dtype=bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    upper = count["upper"] + texts.per_text(capital)
    letters = np.maximum(count["upper"] + count["lower"] + count["high"] // 2, 1)
    other = n_bytes - sum(count[k] for k in ("symbol", "bar", "mark", "stop", "upper", "digit", "lower", "high"))

    key = np.unique(words.doc * max(1, len(words.distinct)) + words.ids)
    distinct = np.bincount(key // max(1, len(words.distinct)), minlength=n) if len(key) else np.zeros(n)
    again = (words.ids[1:] == words.ids[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc[1:][again], minlength=n)

    n_lines, dup_lines = np.zeros(n), np.zeros(n)
    if len(data):
        start = np.zeros(len(data), dtype=bool)
        start[1:] = data[:-1] == 0x0A
        start[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(data))
        coded = binary_array(data, np.append(at, len(data))).dictionary_encode()
        ids, doc = coded.indices.to_numpy().astype(np.int64), np.searchsorted(texts.offsets, at, side="right") - 1
        full = ends - at > 2
        ids, doc = ids[full], doc[full]
        n_lines = np.bincount(doc, minlength=n).astype(float)
        once = np.unique(doc * (len(coded.dictionary) + 1) + ids) // (len(coded.dictionary) + 1)
        dup_lines = n_lines - np.bincount(once, minlength=n)
    per_line = np.maximum(n_lines, 1)
    return np.stack(
        [
            np.log1p(n_words), n_bytes / per_word, count["symbol"] / per_byte, count["bar"] / per_byte, count["mark"] / per_byte,
            upper / letters, count["digit"] / per_byte, other / per_byte, distinct / per_word, repeats / per_word,
            dup_lines / per_line, n_words / per_line, count["stop"] / per_word,
        ],
        axis=1,
    )


class Gam:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, edges, tables, pairs, pair_tables, intercept):
        self.edges, self.tables = edges, tables
        self.pairs, self.pair_tables = pairs, pair_tables
        self.intercept = intercept

    def state(self) -> tuple:
        return self.edges, self.tables, self.pairs, self.pair_tables, self.intercept

    def score(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1: bins are looked up and added."""
        bins = binned(features, self.edges)
        total = np.full(len(features), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse(bins[:, a]), coarse(bins[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(features: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, features[:, f], side="right") for f, e in enumerate(edges)], axis=1)


def coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (BINS + 1)


def leaf(g, h):
    return g / (h + LEAF_WEIGHT)


def tree_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree with two cuts on sums of gradients and weights per bin: the step for each bin."""
    step = np.full(len(g), leaf(g.sum(), h.sum()))
    pieces = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for lo, hi in pieces:
            cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            if not len(cg):
                continue
            tg, th = g[lo:hi].sum(), h[lo:hi].sum()
            gain = cg**2 / (ch + LEAF_WEIGHT) + (tg - cg) ** 2 / (th - ch + LEAF_WEIGHT) - tg**2 / (th + LEAF_WEIGHT)
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (gain[cut], (lo, lo + cut + 1, hi))
        if best[1] is None:
            break
        lo, cut, hi = best[1]
        pieces = [p for p in pieces if p != (lo, hi)] + [(lo, cut), (cut, hi)]
        for a, b in ((lo, cut), (cut, hi)):
            step[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return step


def pair_step(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut into four quadrants of a grid of bins."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, step = 0.0, np.zeros_like(g)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            boxes = ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m))
            sums = [(c[b, d] - c[a, d] - c[b, e] + c[a, e]) for a, b, e, d in boxes for c in (cg, ch)]
            values = [leaf(sums[k], sums[k + 1]) for k in range(0, 8, 2)]
            gain = sum(sums[2 * k] * v for k, v in enumerate(values))
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for (a, b, e, d), v in zip(boxes, values):
                    step[a:b, e:d] = v
    return best, step


def fit_gam(features: np.ndarray, label: np.ndarray) -> Gam:
    """Main effects by cyclic boosting, then interactions of the pairs that gain most."""
    width = features.shape[1] if features.ndim == 2 else len(FEATURES)
    share = (label.sum() + 0.5) / (len(label) + 1)
    intercept = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(label) else np.zeros(0) for f in range(width)]
    tables = [np.zeros(BINS + 1) for _ in range(width)]
    if not len(label) or label.all() or not label.any():
        return Gam(edges, tables, [], [], intercept)
    bins, total = binned(features, edges), np.full(len(label), intercept)

    def slope():
        p = 1 / (1 + np.exp(-total))
        return label - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slope()
            step = RATE * tree_step(np.bincount(bins[:, f], g, BINS + 1), np.bincount(bins[:, f], h, BINS + 1))
            tables[f] += step
            total += step[bins[:, f]]

    def grids(a, b):
        g, h = slope()
        cell = coarse(bins[:, a]) * PAIR_BINS + coarse(bins[:, b])
        shape = (PAIR_BINS, PAIR_BINS)
        return np.bincount(cell, g, PAIR_BINS**2).reshape(shape), np.bincount(cell, h, PAIR_BINS**2).reshape(shape)

    gains = {pair: pair_step(*grids(*pair))[0] for pair in combinations(range(width), 2)}
    pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables):
            step = RATE * pair_step(*grids(a, b))[1]
            table += step
            total += step[coarse(bins[:, a]), coarse(bins[:, b])]
    return Gam(edges, tables, pairs, pair_tables, intercept)


def features_column(text: str = "text") -> Column:
    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        found = [features_of(texts_of(part.column(0))) for part in slices(batch, "text")]
        flat = np.concatenate(found).ravel() if found else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * len(FEATURES), pa.array(flat))

    return features(F.col(text).cast("string"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Gam:
    """Fit on at most `fit_rows` labelled rows, chosen by hash, whose crc32(doc_id as text) mod 5 is not 0."""
    rows = labelled_rows(docs, labels, "quality")
    drawn = labelled_sample(rows, fit_rows).select("draw", "doc_id", "label", features_column().alias("features"))
    sample = drawn.orderBy("draw", "doc_id").limit(fit_rows).toArrow()
    features = np.array(sample.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_gam(features, sample.column("label").to_numpy())


def labelled_sample(rows: DataFrame, fit_rows: int) -> DataFrame:
    """Rows below a bound on the hash that leaves somewhat more than `fit_rows`, to spare the others' features.

    The share is of the rows that have both a document and a label; counting them reads no text.
    """
    share = min(1.0, 1.5 * fit_rows / max(1, rows.count()))
    return rows.filter(F.col("draw") < F.lit(int((share - 0.5) * (1 << 64)) if share < 1 else (1 << 63) - 1))


def score_quality(docs: DataFrame, gam: Gam, text: str = "text") -> Column:
    """A column with each text's score from 0 to 1, from the text alone; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(gam.state())

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch, model = pa.RecordBatch.from_arrays([column], ["text"]), Gam(*shared.value)
        found = [model.score(features_of(texts_of(part.column(0)))) for part in slices(batch, "text")]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(F.col(text).cast("string"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows and score every row: doc_id, held_out, score, predicted (score >= 0.3).

    A null or empty text has all features 0 and gets the score of such a text. Without labels of both
    kinds every score is the share of label 1 (one half without any labels). Repeated rows get equal
    scores. An empty table gives no rows. Other columns are ignored.
    """
    gam = fit_quality(docs, labels)
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), score_quality(docs, gam).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
