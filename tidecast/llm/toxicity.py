"""Toxicity by two Kneser-Ney models over the letters of words, one per class, with shared backoff.

Each class counts 8-byte windows inside words. What a class has not seen falls back to lower orders
counted over both classes together, so an expression rare in both says nothing. A word's evidence is
the log-ratio of its two likelihoods beyond a margin; a text's is the mean over its words, drawn towards
none by PRIOR_WORDS words without evidence. The margin and the curve from evidence to probability come
from rows set apart.

Every window counts, however rare. Each different word of the corpus is taken apart once, in blocks of
words. A block sends its different windows, packed, to the owners of their contexts, and gets log-ratios
back: all windows that end in the same BASE_ORDER bytes before the last are with one owner, which so has
whole contexts of every higher order. Only words with evidence go back to the texts. Words are told apart
by 64-bit hashes there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.joins import BROADCAST_ROWS
from tidecast.llm.labelled import held_out, labelled_rows
from tidecast.llm.shards import listed, shard_numbers
from tidecast.llm.text_batches import Pieces, Words, give_back_memory, pieces_of, slices, texts_of, words_of
from tidecast.sources.tables import staged

ORDER = 8
BASE_ORDER = 3  # this order and the lower ones are made on the driver, from 2 ** 24 grams at most
DISCOUNT = 0.75
PRIOR_WORDS = 100  # without evidence, added to each text; evidence is per as many words
MARGINS = (2.0, 4.0, 6.0, 8.0)
SLICE_BYTES = 2 << 20  # of text
BLOCK_BYTES = 2 << 20  # of words; their windows take some thirty times as much
WORDS_PER_OWNER = 1 << 14  # of the corpus, for each owner of windows
HELD_WORDS = 200_000
HELD_BYTES = 16 << 20
CALIBRATION_ROWS = 20_000
CALIBRATION_FOLD = 5

BLOCK_COLUMNS = ["word", "toxic_count", "ordinary_count"]
BLOCKS = "block long, word array<binary>, toxic_count array<long>, ordinary_count array<long>"
MESSAGE_COLUMNS = ["owner", "block", "n", "grams", "toxic", "ordinary"]
MESSAGES = "owner long, block long, n long, grams binary, toxic binary, ordinary binary"
MESSAGE_TYPES = pa.schema([(c, pa.int64() if c in ("owner", "block", "n") else pa.binary()) for c in MESSAGE_COLUMNS])

# Bytes of letters in lower case; every other ASCII byte is a space.
LETTERS = np.full(256, 0x20, dtype=np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def windows(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ORDER bytes that end in a word or just after it, packed, and the piece each is in."""
    gap = b" " * (ORDER - 1)
    data = np.frombuffer(gap + gap.join(distinct) + gap, dtype=np.uint8)
    owner = np.repeat(np.arange(len(distinct)), np.fromiter(map(len, distinct), np.int64, len(distinct)) + len(gap))
    letters = LETTERS[data]  # the first gap has no owner
    # Capital letters with accents, À to Þ, are C3 80 to C3 9E.
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
    letters[1:][capital] += 0x20
    # The lead byte C3 of Latin letters with accents is left out, so that they are one byte like others.
    letters, owner = letters[data != 0xC3], owner[data[len(gap) :] != 0xC3]
    packed = np.zeros(len(letters), dtype=np.uint64)
    for back in range(ORDER):
        packed[back:] |= letters[: len(letters) - back].astype(np.uint64) << np.uint64(8 * back)
    at = np.flatnonzero((letters[1:] != 0x20) | (letters[:-1] != 0x20)) + 1
    return packed[at], owner[at - len(gap)] if len(distinct) else at


def letters_of(word: bytes) -> bytes:
    """What windows() reads of a word, b"" if it has no letters."""
    return word.translate(LETTERS.tobytes()).strip(b" ")


def word_ids(distinct: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in distinct), dtype=np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """Each different word of rows with text and label: word, toxic_count, ordinary_count.

    Words of rows without a label are listed, but not counted.
    """

    def count(batches):
        index: dict[bytes, int] = {}
        counts, held_bytes = np.zeros((2, HELD_WORDS), dtype=np.int64), 0

        def out():
            words = list(index)
            toxic, ordinary = counts[:, : len(words)].copy()
            columns = [pa.array(words, pa.binary()), pa.array(toxic), pa.array(ordinary)]
            return pa.RecordBatch.from_arrays(columns, ["word", "toxic_count", "ordinary_count"])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words = words_of(texts_of(part.column("text")), letters_of)
                label = pc.fill_null(part.column("label"), -1).to_numpy(zero_copy_only=False)[words.doc]
                before = len(index)
                at = np.fromiter((index.setdefault(w, len(index)) for w in words.distinct), np.int64, len(words.distinct))
                held_bytes += sum(map(len, list(index)[before:]))
                if len(index) > counts.shape[1]:
                    counts = np.pad(counts, ((0, 0), (0, len(index))))
                for row, value in enumerate((1, 0)):
                    counts[row][at] += np.bincount(words.ids[label == value], minlength=len(at))
                if len(index) > HELD_WORDS or held_bytes > HELD_BYTES:
                    yield out()
                    index.clear()
                    counts, held_bytes = np.zeros((2, HELD_WORDS), dtype=np.int64), 0
        yield out()

    counted = rows.select("text", "label").mapInArrow(count, "word binary, toxic_count long, ordinary_count long")
    return counted.groupBy("word").agg(
        F.sum("toxic_count").alias("toxic_count"), F.sum("ordinary_count").alias("ordinary_count")
    )


def word_blocks(words: DataFrame) -> DataFrame:
    """The words with their counts, some BLOCK_BYTES of them a row."""

    def gather(batches):
        numbers = shard_numbers()
        held, held_bytes = [], 0

        def out():
            table = pa.Table.from_batches(held)
            columns = [pa.array([next(numbers)], pa.int64()), *(listed(table.column(c)) for c in BLOCK_COLUMNS)]
            return pa.RecordBatch.from_arrays(columns, ["block", *BLOCK_COLUMNS])

        for batch in batches:
            for part in slices(batch, "word", BLOCK_BYTES):
                held.append(part)
                held_bytes += part.column("word").nbytes
                if held_bytes >= BLOCK_BYTES:
                    yield out()
                    held, held_bytes = [], 0
        if held:
            yield out()

    return words.select(*BLOCK_COLUMNS).mapInArrow(gather, BLOCKS)


@dataclass
class BlockWindows:
    """The different windows of a block in the order of owners, and where each word has them."""

    words: list[bytes]
    grams: np.ndarray
    counts: list[np.ndarray]
    owners: np.ndarray
    gram_of: np.ndarray
    word_of: np.ndarray


def block_windows(batch, row: int, owners: int) -> BlockWindows:
    words = batch.column("word")[row].values.to_pylist()
    keys, word_of = windows(words)
    grams, gram_of = np.unique(keys, return_inverse=True)
    counts = [
        np.bincount(gram_of, batch.column(c)[row].values.to_numpy()[word_of], len(grams)).astype(np.int64)
        for c in ("toxic_count", "ordinary_count")
    ]
    context = (grams >> np.uint64(8)) & np.uint64((1 << (8 * BASE_ORDER)) - 1)
    owner = ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % owners
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return BlockWindows(words, grams[order], [c[order] for c in counts], owner[order], place[gram_of], word_of)


def packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed: sorted or small ones have planes that hardly change."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def discounted(low: np.ndarray, contexts: np.ndarray, backoff: np.ndarray) -> np.ndarray:
    _, inside, kinds = np.unique(low >> np.uint64(8), return_inverse=True, return_counts=True)
    total = np.bincount(inside, contexts)[inside]
    return (contexts - DISCOUNT) / total + DISCOUNT * kinds[inside] / total * backoff


def shared_probability(grams: np.ndarray, order: int, base=None) -> np.ndarray:
    """Kneser-Ney probability of the last byte of each gram from how many different bytes come before.

    With `base`, grams of BASE_ORDER and their probabilities, the orders below are looked up there.
    """
    mask = np.uint64((1 << (8 * order)) - 1)
    low, where, contexts = np.unique(grams & mask, return_inverse=True, return_counts=True)
    if base is not None and order == BASE_ORDER:
        return looked_up(*base, low, 1.0)[where]
    if order == 1:
        return (contexts / contexts.sum())[where]
    return discounted(low, contexts, shared_probability(low, order - 1, base))[where]


def base_probabilities(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared probabilities of BASE_ORDER: the grams, at most 2 ** 24, and their probabilities."""
    longer, mask = np.uint64((1 << (8 * (BASE_ORDER + 1))) - 1), (1 << (8 * BASE_ORDER)) - 1

    def ends(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = block_windows(batch, row, 1)
                grams = np.unique(own.grams[(own.counts[0] + own.counts[1]) > 0] & longer)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["longer"])
            give_back_memory()

    grams = blocks.mapInArrow(ends, "longer long").distinct()
    grams = grams.groupBy(F.col("longer").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("contexts"))
    found = grams.orderBy("gram").toArrow()
    low, contexts = (found.column(c).to_numpy() for c in ("gram", "contexts"))
    low = low.view(np.uint64)
    return low, discounted(low, contexts, shared_probability(low, BASE_ORDER - 1)) if len(low) else np.zeros(0)


def word_ratios(blocks: DataFrame, owners: int) -> DataFrame:
    """The log-ratio of each word of the blocks above the least margin: word_id, ratio.

    A word's is the sum over its windows; blocks ask the owners of the windows for theirs.
    """
    base = blocks.sparkSession.sparkContext.broadcast(base_probabilities(blocks))

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = block_windows(batch, row, owners)
                cuts = np.flatnonzero(np.diff(own.owners)) + 1
                block = batch.column("block")[row].as_py()
                for first, last in zip([0, *cuts], [*cuts, len(own.owners)]):
                    if first == last:
                        continue
                    columns = [packed(x[first:last]) for x in (own.grams, *own.counts)]
                    message = [int(own.owners[first]), block, int(last - first), *columns]
                    yield pa.RecordBatch.from_pylist([dict(zip(MESSAGE_COLUMNS, message))], MESSAGE_TYPES)
            give_back_memory()

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        grams, toxic, ordinary = (
            np.concatenate([unpacked(data.as_buffer(), n, dtype) for data, n in zip(table.column(c), sizes)])
            for c, dtype in zip(("grams", "toxic", "ordinary"), (np.uint64, np.int64, np.int64))
        )
        distinct, at = np.unique(grams, return_inverse=True)
        toxic, ordinary = (np.bincount(at, c, len(distinct)).astype(np.int64) for c in (toxic, ordinary))
        seen = toxic + ordinary > 0
        ratios = kneser_ney(distinct[seen], toxic[seen], ordinary[seen], base.value).ratios_of(distinct)[at]
        cuts = np.cumsum([0, *sizes])
        replies = [packed(ratios[a:b]) for a, b in zip(cuts, cuts[1:])]
        give_back_memory()
        return table.select(["owner", "block", "n"]).append_column("ratios", pa.array(replies, pa.binary()))

    def add_up(block: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("owner")
        parts = [unpacked(d.as_buffer(), n.as_py(), np.float64) for d, n in zip(replies.column("ratios"), replies.column("n"))]
        own = block_windows(block.combine_chunks(), 0, owners)
        ratios = np.concatenate([np.zeros(0), *parts])[own.gram_of]
        sums = np.bincount(own.word_of, ratios, len(own.words))
        over = np.flatnonzero(sums > min(MARGINS))
        give_back_memory()
        return pa.table({"word_id": pa.array(word_ids([own.words[i] for i in over])), "ratio": pa.array(sums[over])})

    messages = blocks.mapInArrow(ask, MESSAGES)
    replies = messages.groupBy("owner").applyInArrow(answer, "owner long, block long, n long, ratios binary")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add_up, "word_id long, ratio double")


@dataclass
class WindowModel:
    """The log-ratios of a few windows, in memory."""

    windows: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    context_ratios: np.ndarray

    def ratios_of(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each window; one that no class has gets what its context says."""
        ratio = looked_up(self.windows, self.ratios, keys, np.nan)
        unseen = np.isnan(ratio)
        ratio[unseen] = looked_up(self.contexts, self.context_ratios, keys[unseen] >> np.uint64(8), 0.0)
        return ratio

    def evidence(self, texts, margins) -> np.ndarray:
        """Length-normalised evidence of each text for each margin, one row per text."""
        pieces: Pieces = pieces_of(texts)
        keys, owner = windows(pieces.distinct)
        ratios = np.bincount(owner, self.ratios_of(keys), len(pieces.distinct))
        has_letters = np.bincount(owner, minlength=len(pieces.distinct)) > 0
        index = np.cumsum(has_letters) - 1
        words = has_letters[pieces.ids]
        return text_evidence(index[pieces.ids[words]], pieces.doc[words], ratios[has_letters], texts.count, margins)


@dataclass
class ToxicityModel:
    """Words with a log-ratio above the least margin, as a stored table of word_id and ratio, and the curve."""

    words: DataFrame
    margin: float = MARGINS[0]
    slope: float = 1.0
    intercept: float = -1.0


def text_evidence(ids: np.ndarray, doc: np.ndarray, ratios: np.ndarray, count: int, margins) -> np.ndarray:
    """Length-normalised evidence of texts for each margin, from the log-ratio of each of their words."""
    over = [np.bincount(doc, np.maximum(ratios - m, 0)[ids], count) for m in margins]
    return np.log1p(PRIOR_WORDS * np.stack(over, axis=1) / (np.bincount(doc, minlength=count) + PRIOR_WORDS)[:, None])


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def kneser_ney(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, base=None) -> WindowModel:
    """Log-ratios of the two class models, for windows and for contexts followed by something unseen.

    With `base` (see shared_probability) the grams are an owner's share, which may lack a class.
    """
    if not len(grams) or (base is None and not (toxic.any() and ordinary.any())):
        none = np.zeros(0)
        return WindowModel(none.astype(np.uint64), none, none.astype(np.uint64), none)
    order = np.argsort(grams)
    grams, toxic, ordinary = grams[order], toxic[order], ordinary[order]
    shared = shared_probability(grams, ORDER - 1, base)
    contexts, inside = np.unique(grams >> np.uint64(8), return_inverse=True)
    logs, unseen = [], []
    for counts in (toxic, ordinary):
        total, kinds = np.bincount(inside, counts), np.bincount(inside, counts > 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[inside]
        logs.append(np.log(own + left[inside] * shared))
        unseen.append(np.log(left))
    return WindowModel(grams, logs[0] - logs[1], contexts, unseen[0] - unseen[1])


def logistic(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and (intercept, slope) of a logistic curve by Newton's method, with a weak pull to the start values."""
    x, y = np.stack([np.ones(len(evidence)), evidence]), toxic.astype(float)
    start = np.array([-3.0, 3.0])
    weights = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(weights @ x, -30, 30)))
        gradient = x @ (y - p) - 0.05 * (weights - start)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.05 * np.eye(2), gradient)
        weights += np.clip(step, -2, 2)
    z = np.clip(weights @ x, -30, 30)
    return float(np.sum(np.log1p(np.exp(z)) - y * z)), weights


def calibrated(model: ToxicityModel, evidence: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """The margin with the least loss on the calibration rows, and its curve."""
    fits = [logistic(evidence[:, i], toxic) for i in range(len(MARGINS))]
    best = min(range(len(MARGINS)), key=lambda i: fits[i][0])
    model.margin = MARGINS[best]
    model.intercept, model.slope = map(float, fits[best][1])
    return model


def toxic_words(rows: DataFrame) -> DataFrame:
    """The words of rows with text and label whose log-ratio is above the least margin: word_id, ratio.

    The others are evidence for no margin. Labels of both classes are needed, or there are none.
    """
    words = staged(word_counts(rows), "words")
    totals = words.agg(F.sum("toxic_count").alias("t"), F.sum("ordinary_count").alias("o")).first()
    if not totals["t"] or not totals["o"]:
        return rows.sparkSession.createDataFrame([], "word_id long, ratio double")
    owners = max(1, words.count() // WORDS_PER_OWNER)
    return staged(word_ratios(staged(word_blocks(words), "blocks"), owners), "toxic_words")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on rows whose crc32(doc_id as text) mod 5 is not 0, for scoring the texts of `docs`.

    All of them are counted but for one in CALIBRATION_FOLD, of which at most CALIBRATION_ROWS, by hash,
    set the logistic curve from evidence to probability. All windows of the others are used. The driver
    gets the calibration rows' evidence, and the words with evidence if they are few.
    """
    apart = F.pmod("draw", F.lit(CALIBRATION_FOLD)) == 0
    rows = labelled_rows(docs, labels, "toxic", how="left")
    words = toxic_words(rows.withColumn("label", F.when(~apart, F.col("label"))))
    sample = labelled_rows(docs, labels, "toxic").filter(apart).orderBy("draw").limit(CALIBRATION_ROWS)
    sample = with_evidence(sample, words, MARGINS).select("label", "evidence").toArrow()
    evidence = np.array(sample.column("evidence").to_pylist(), dtype=float).reshape(-1, len(MARGINS))
    return calibrated(ToxicityModel(words), evidence, sample.column("label").to_numpy())


def with_evidence(docs: DataFrame, words: DataFrame, margins, text: str = "text") -> DataFrame:
    """The rows with an array `evidence`, one entry per margin. Up to BROADCAST_ROWS words go to all tasks."""
    if words.count() > BROADCAST_ROWS:
        return joined_evidence(docs, words, margins, text)
    known = words.orderBy("word_id").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([known.column(c).to_numpy() for c in ("word_id", "ratio")])

    @F.arrow_udf("array<double>")
    def evidence(column: pa.Array) -> pa.Array:
        batch, found = pa.RecordBatch.from_arrays([column], ["text"]), []
        for part in slices(batch, "text", SLICE_BYTES):
            texts = texts_of(part.column(0))
            own: Words = words_of(texts, letters_of)
            ratios = looked_up(*shared.value, word_ids(own.distinct), 0.0)
            found.append(text_evidence(own.ids, own.doc, ratios, texts.count, margins))
        flat = np.concatenate(found).ravel() if found else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * len(margins), pa.array(flat))

    return docs.withColumn("evidence", evidence(F.col(text).cast("string")))


def joined_evidence(docs: DataFrame, words: DataFrame, margins, text: str = "text") -> DataFrame:
    """with_evidence() by joins, for any number of words. Equal texts, by md5, are looked up once."""

    def listed(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                own = words_of(texts_of(part.column("text")), letters_of)
                pairs, times = np.unique(own.doc * max(len(own.distinct), 1) + own.ids, return_counts=True)
                doc, ids = np.divmod(pairs, max(len(own.distinct), 1))
                length = np.bincount(own.doc, minlength=part.num_rows)[doc]
                columns = [part.column("md5").take(pa.array(doc)), pa.array(word_ids(own.distinct)[ids]), pa.array(times), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, ["md5", "word_id", "times", "length"])

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.md5(value).alias("md5"), value.alias("text"))
    pairs = rows.mapInArrow(listed, "md5 string, word_id long, times long, length long").distinct()
    over = [F.sum(F.col("times") * F.greatest(F.col("ratio") - m, F.lit(0.0))) for m in margins]
    found = pairs.join(words, "word_id").groupBy("md5", "length").agg(*[o.alias(f"over{i}") for i, o in enumerate(over)])
    logs = F.array(*[F.log1p(PRIOR_WORDS * F.col(f"over{i}") / (F.col("length") + PRIOR_WORDS)) for i in range(len(margins))])
    found = found.select(F.col("md5").alias("_md5"), logs.alias("_found"))
    none = F.array(*[F.lit(0.0)] * len(margins))
    rows = docs.withColumn("_md5", F.md5(value)).join(found, "_md5", "left")
    return rows.withColumn("evidence", F.coalesce("_found", none)).drop("_md5", "_found")


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows with `toxicity`, each text's probability of being toxic; null counts as empty.

    The texts are those that the model was fitted for, or have no other words.
    """
    scored = with_evidence(docs, model.words, (model.margin,), text)
    evidence = F.lit(model.intercept) + F.lit(model.slope) * F.col("evidence")[0]
    return scored.withColumn("toxicity", 1 / (1 + F.exp(-evidence))).drop("evidence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every row: doc_id, held_out, score, predicted (score >= 0.5).

    A null or empty text has no evidence and gets the curve's value there. Without training rows of both
    classes nothing is evidence. Of several labels of a doc_id the highest counts; null labels and labels
    without a document count for nothing. Repeated rows get equal scores. An empty table gives no rows.
    Other columns are ignored.
    """
    model = fit_toxicity(docs, labels)
    rows = with_score(docs.select("doc_id", "text"), model)
    scored = rows.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with their columns."""
    scored = with_score(docs.select(F.struct("*").alias("row"), "text"), fit_toxicity(docs, labels))
    return scored.filter(F.col("toxicity") < threshold).select("row.*")
