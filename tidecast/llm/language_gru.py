"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word byte by byte in both directions and labels every position. A document's
probabilities pool the log-probabilities of all positions of all its words. Words are independent, so
a batch runs the network once for each different word. Training is backpropagation through time, in
numpy, on a bounded sample of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.labelled import fold, held_out
from tidecast.llm.text_batches import slices, texts_of, words_of, worker_cache

HIDDEN = 12
STEPS = 16  # a longer word is read in pieces of this many bytes
TRAIN_DOCS = 4_000
TRAIN_WORDS = 40_000
EPOCHS = 2
BATCH = 256
RATE = 0.02
SEED = 7
RUN_WORDS = 4_096
CACHED_WORDS = 300_000
UNDETERMINED = "und"
PAD = 256  # no byte
EDGE = 257  # stands before and after a word


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(n_labels: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def draw(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    parameters = {"v": draw(2 * HIDDEN, n_labels, scale=0.3), "c": np.zeros(n_labels, np.float32)}
    for way in "fb":
        # What each byte adds to the update, reset and new-state sums, and what the state adds.
        parameters["x" + way] = draw(EDGE + 1, 3 * HIDDEN, scale=0.3)
        parameters["u" + way] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
    return parameters


def run_way(x, u, ids, mask, backward, keep):
    """States after each position, (steps, words, HIDDEN); and what training needs of each step."""
    steps, words = ids.shape
    state, states, kept = np.zeros((words, HIDDEN), np.float32), np.empty((steps, words, HIDDEN), np.float32), []
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        a, g = x[ids[t]], state @ u
        zr = sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        before = state
        state = np.where(mask[t], new + z * (before - new), before)
        states[t] = state
        if keep:
            kept.append((t, before, z, r, new, g[:, 2 * HIDDEN :]))
    return states, kept


def way_gradients(u, ids, mask, kept, d_states):
    """Gradients of the byte table and the recurrent matrix, backwards through the steps of `run_way`."""
    d_u = np.zeros_like(u)
    d_sums = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
    d_state = np.zeros(d_states.shape[1:], np.float32)
    for t, before, z, r, new, g_new in reversed(kept):
        d_state = d_state + d_states[t]
        d = np.where(mask[t], d_state, 0)
        d_tanh = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_tanh * g_new * r * (1 - r)
        d_sums[t] = np.concatenate([d_z, d_r, d_tanh], axis=1)
        d_g = np.concatenate([d_z, d_r, d_tanh * r], axis=1)
        d_u += before.T @ d_g
        d_state = np.where(mask[t], d * z, d_state) + d_g @ u.T
    flat, sums = ids.ravel(), d_sums.reshape(-1, 3 * HIDDEN)
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
    d_x = np.zeros((EDGE + 1, 3 * HIDDEN), np.float32)
    d_x[flat[order][starts]] = np.add.reduceat(sums[order], starts, axis=0)
    return d_x, d_u


def log_probabilities(parameters, ids, mask, keep=False):
    """Log-probability of each label at every position, (steps, words, labels)."""
    forward, kept_f = run_way(parameters["xf"], parameters["uf"], ids, mask, False, keep)
    backward, kept_b = run_way(parameters["xb"], parameters["ub"], ids, mask, True, keep)
    both = np.concatenate([forward, backward], axis=2)
    logits = both @ parameters["v"] + parameters["c"]
    logits -= logits.max(axis=2, keepdims=True)
    logs = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    return logs, both, kept_f, kept_b


def gradients(parameters, ids, mask, labels) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over all real positions."""
    logs, both, kept_f, kept_b = log_probabilities(parameters, ids, mask, keep=True)
    d_logits = np.exp(logs)
    d_logits[:, np.arange(ids.shape[1]), labels] -= 1
    d_logits = np.where(mask, d_logits, 0) / max(1, int(mask.sum()))
    d_both = (d_logits @ parameters["v"].T).astype(np.float32)
    out = {"v": np.einsum("twh,twk->hk", both, d_logits), "c": d_logits.sum(axis=(0, 1))}
    out["xf"], out["uf"] = way_gradients(parameters["uf"], ids, mask, kept_f, d_both[:, :, :HIDDEN])
    out["xb"], out["ub"] = way_gradients(parameters["ub"], ids, mask, kept_b, d_both[:, :, HIDDEN:])
    return out


def as_steps(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by step, a mask of real positions, and the word of each column; edges are read, not labelled."""
    parts = [(i, w[at : at + STEPS]) for i, w in enumerate(words) for at in range(0, len(w), STEPS)]
    steps = max((len(p) for _, p in parts), default=0) + 2
    ids = np.full((len(parts), steps), PAD, dtype=np.int64)
    lengths = np.fromiter((len(p) for _, p in parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(p for _, p in parts), dtype=np.uint8)
    inside = np.arange(steps)[None, :]
    mask = (inside >= 1) & (inside <= lengths[:, None])
    ids[mask] = flat
    ids[:, 0] = EDGE
    ids[np.arange(len(parts)), lengths + 1] = EDGE
    return ids.T.copy(), mask.T[:, :, None].copy(), np.fromiter((i for i, _ in parts), np.int64, len(parts))


def train(words: list[bytes], labels: np.ndarray, n_labels: int, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Adam on batches of words of similar length."""
    rng = np.random.default_rng(SEED)
    parameters = new_parameters(n_labels, rng)
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in parameters.items()}
    by_length = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    batches = [by_length[at : at + BATCH] for at in range(0, len(words), BATCH)]
    total, step = max(1, epochs * len(batches)), 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            ids, mask, owner = as_steps([words[i] for i in batches[b]])
            found = gradients(parameters, ids, mask, labels[batches[b]][owner])
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in found.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                scale = np.sqrt(second / (1 - 0.99**step)) + 1e-8
                parameters[k] -= (rate * first / (1 - 0.9**step) / scale).astype(np.float32)
    return parameters


class LanguageModel:
    def __init__(self, languages: list[str], parameters: dict[str, np.ndarray]):
        self.languages, self.parameters = languages, parameters

    def word_sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the log-probabilities summed over its positions, and the number of positions."""
        sums = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), RUN_WORDS):
            some = order[at : at + RUN_WORDS]
            ids, mask, owner = as_steps([words[i] for i in some])
            logs = np.where(mask, log_probabilities(self.parameters, ids, mask)[0], 0).sum(axis=0)
            for k in range(len(self.languages)):
                sums[some, k] = np.bincount(owner, logs[:, k], len(some))
        return sums, lengths

    def document_probabilities(self, texts, known: dict[bytes, np.ndarray]) -> np.ndarray:
        """Geometric mean over a text's positions of the label probabilities, scaled to add up to 1."""
        words = words_of(texts)
        missing = [w for w in words.distinct if w not in known]
        fresh = dict(zip(missing, self.word_sums(missing)[0]))
        sums = np.array([known[w] if w in known else fresh[w] for w in words.distinct]).reshape(-1, len(self.languages))
        known.update(list(fresh.items())[: max(0, CACHED_WORDS - len(known))])
        lengths = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))
        positions = np.bincount(words.doc, lengths[words.ids] if len(words.ids) else None, texts.count)
        total = np.stack([np.bincount(words.doc, sums[words.ids, k], texts.count) for k in range(len(self.languages))], axis=1)
        mean = total / np.maximum(positions, 1)[:, None]
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def training_words(docs: DataFrame, train_docs: int, train_words: int) -> DataFrame:
    """Words with a language: at most `train_words`, drawn by a hash with weight by their frequency, from
    whole texts of at most `train_docs` labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    allowed = docs.filter(F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False)) & F.col("lang").isNotNull())
    draw = F.xxhash64("doc_id", "lang")
    # The threshold on the hash of the doc_id gives about the wanted number without a sort of the texts.
    share = min(1.0, train_docs / max(1, allowed.select("doc_id").count()))
    bound = int((share - 0.5) * (1 << 64)) if share < 1 else (1 << 63) - 1
    words = (
        allowed.filter(draw <= F.lit(bound))
        .select(F.col("lang").cast("string").alias("lang"), F.explode(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+")).alias("word"))
        .filter(F.col("word").rlike(r"\p{L}"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    uniform = (F.pmod(F.xxhash64("word", "lang"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return words.withColumn("draw", -F.log(uniform) / F.col("n")).orderBy("draw", "lang", "word").limit(train_words)


def fit_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> LanguageModel:
    rows = training_words(docs, train_docs, train_words).select("lang", "word").toArrow()
    found = rows.column("lang").to_pylist()
    languages = sorted(set(found))
    index = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([index[x] for x in found], dtype=np.int64)
    return LanguageModel(languages, train([w.encode() for w in rows.column("word").to_pylist()], labels, max(1, len(languages))))


def language_column(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A column struct<lang, score> of each text, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.parameters))
    run = str(shared._jbroadcast.id()) + docs.sparkSession.sparkContext.applicationId

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(column: pa.Array) -> pa.Array:
        network, known = LanguageModel(*shared.value), worker_cache(f"language {run}")
        letters = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        names, scores = [], []
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            if network.languages:
                odds = network.document_probabilities(texts_of(part.column(0)), known)
                names += [network.languages[k] for k in odds.argmax(axis=1)]
                scores += odds.max(axis=1).tolist()
            else:
                names += [UNDETERMINED] * part.num_rows
                scores += [0.0] * part.num_rows
        names = [n if ok else UNDETERMINED for n, ok in zip(names, letters)]
        scores = [float(s) if ok else 0.0 for s, ok in zip(scores, letters)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predicted(F.col(text).cast("string"))


def languages(docs: DataFrame) -> DataFrame:
    """Fit on labelled rows and predict every row: doc_id, held_out, lang_pred, score.

    A null text and one without a letter get "und" with score 0; so does every text if no row has a
    language to learn from. Rows without a doc_id are predicted, not learned from. Repeated rows get
    equal results. An empty table gives no rows. Other columns are ignored.
    """
    model = fit_languages(docs)
    found = docs.select("doc_id", held_out(4, 2).alias("held_out"), language_column(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
