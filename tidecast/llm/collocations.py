"""Phrases whose words occur together more than alone, counted in counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.joins import checked
from tidecast.llm.shards import found_array, listed, numbered, regrouped, shard_numbers
from tidecast.llm.text_batches import binary_array, slices, texts_of
from tidecast.sources.tables import staged

MOST_WORDS = 3
MINIMUM = 10
CONTAINED_PERCENT = 50
REPORTED = 2000
BLOCK_BYTES = 8 << 20
NGRAMS_PER_OWNER = 1 << 21
MERGED_AT_ONCE = 1 << 21
NO_LANGUAGE = "und"

# Bytes that end a piece, bytes between words, and the letters that are lower-cased.
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Multipliers of the permutation's rounds: odd numbers made from a linear congruence.
ROUNDS = [((k * 6364136223846793005 + 1442695040888963407) % (1 << 64)) | 1 for k in range(1, 5)]

SHARDS = "shard long, lang string, word array<string>, times array<long>, total long, tokens binary"
FILTERS = (
    "owner long, quotient_bits int, slots long, occupied binary, runends binary, digits binary, remainders binary"
)
COUNTED = "w1 long, w2 long, w3 long, a long"


# Words


def blocks(data: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """The bytes cut after a break into parts of about `limit`; only a longer piece makes a longer part."""
    start = 0
    while len(data) - start > limit:
        at = np.flatnonzero(BREAK[data[start : start + limit]])
        stop = start + int(at[-1]) + 1 if len(at) else 0
        ahead = start + limit
        while not stop and ahead < len(data):
            at = np.flatnonzero(BREAK[data[ahead : ahead + limit]])
            stop = ahead + int(at[0]) + 1 if len(at) else 0
            ahead += limit
        if not stop:
            break
        yield data[start:stop]
        start = stop
    if start < len(data):
        yield data[start:]


def words_in(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the word at each place, and whether a place begins a piece."""
    data = LOWER[data]
    inside = ~GAP[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    encoded = binary_array(data[inside], offsets).dictionary_encode()
    piece = np.cumsum(BREAK[data], dtype=np.int32)[starts]
    fresh = np.diff(piece, prepend=np.int32(-1)) != 0
    return encoded.dictionary.cast(pa.large_string()), encoded.indices.to_numpy(zero_copy_only=False), fresh


def word_shards(docs: DataFrame) -> DataFrame:
    """Documents of one language as word numbers: twice the place in `word`, plus 1 at the start of a piece."""

    def run(batches):
        numbers = shard_numbers()
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                for lang in part.column("lang").unique().to_pylist():
                    own = part.filter(pc.equal(part.column("lang"), lang)).column("text")
                    # A break between two documents, so that no phrase spans them.
                    joined = pc.binary_join(listed(own.cast(pa.large_string())), pa.scalar("\n", pa.large_string()))
                    for block in blocks(texts_of(joined).data):
                        words, at, fresh = words_in(block)
                        if len(at):
                            tokens = (at.astype("<u4") << 1) | fresh
                            times = pa.array(np.bincount(at, minlength=len(words)))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([next(numbers)]), pa.array([lang]), listed(words.cast(pa.string())), listed(times),
                                    pa.array([len(at)]), pa.array([tokens.tobytes()], pa.binary()),
                                ],
                                ["shard", "lang", "word", "times", "total", "tokens"],
                            )

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    return rows.where(F.col("text").isNotNull()).mapInArrow(run, SHARDS)


def vocabulary(shards: DataFrame, minimum: int) -> DataFrame:
    """Words of each language with at least `minimum` occurrences: lang, word, f and a dense id.

    A phrase occurs no oftener than any of its words, so words below the minimum are in no candidate.
    """
    counts = (
        shards.select("lang", F.explode(F.arrays_zip("word", "times")).alias("entry"))
        .groupBy("lang", F.col("entry.word").alias("word"))
        .agg(F.sum("entry.times").alias("f"))
        .where(F.col("f") >= minimum)
    )
    stored = staged(counts.withColumn("place", F.monotonically_increasing_id()), "vocabulary")
    return staged(numbered(stored, "id"), "vocabulary")


# N-grams as numbers


def half_bits(id_bits: int) -> int:
    """Bits of each half of a packed n-gram."""
    if id_bits > 32:
        raise ValueError("more than 2^32 words with enough occurrences in one corpus")
    return -(-MOST_WORDS * id_bits // 2)


def mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def scrambled(half: np.ndarray, factor: int, bits: int) -> np.ndarray:
    mixed = (half + np.uint64(1)) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor) >> np.uint64(64 - bits)


def permuted(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The high and low half of the packed ids, permuted in rounds that can be undone."""
    h, b = half_bits(id_bits), np.uint64(id_bits)
    two = w1 | (w2 << b)
    low, high = two & mask(h), (two >> np.uint64(h)) | (w3 << np.uint64(2 * id_bits - h))
    for first, second in zip(ROUNDS[::2], ROUNDS[1::2]):
        low = low ^ scrambled(high, first, h)
        high = high ^ scrambled(low, second, h)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, b = half_bits(id_bits), np.uint64(id_bits)
    for first, second in reversed(list(zip(ROUNDS[::2], ROUNDS[1::2]))):
        high = high ^ scrambled(low, second, h)
        low = low ^ scrambled(high, first, h)
    rest = 2 * id_bits - h
    two = low | ((high & mask(rest)) << np.uint64(h))
    return two & mask(id_bits), two >> b, high >> np.uint64(rest)


def counted(high: np.ndarray, low: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, and how often each occurs."""
    if 2 * h <= 64:
        values = np.sort((high << np.uint64(h)) | low)
        high, low = values >> np.uint64(h), values & mask(h)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
    new = np.ones(len(high), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    return high[at], low[at], np.diff(np.append(at, len(high)))


def owner_bits(ngrams: int, id_bits: int, per_owner: int = NGRAMS_PER_OWNER) -> int:
    """Leading bits that name an owner: enough that one holds about `per_owner`, and 64 are left at most."""
    h = half_bits(id_bits)
    return min(h, max(3, (max(1, ngrams) // per_owner).bit_length(), 2 * h - 64))


# Counting quotient filters


def packed_bits(values: np.ndarray, bits: int) -> bytes:
    spread = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(spread[:, 64 - bits :]).tobytes()


def unpacked_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    plain = np.zeros((count, 64), dtype=np.uint8)
    plain[:, 64 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(plain, axis=1).view(">u8").ravel().astype(np.uint64)


def filter_of(values: np.ndarray, counts: np.ndarray, value_bits: int) -> dict:
    """The filter of sorted different values of `value_bits` bits, with their counts (below 2^53).

    A value is its quotient, the high bits, and its full remainder. Remainders of one quotient are a run of
    slots at or after the quotient's own place; `occupied` marks quotients that have a run and `runends` the
    last slot of each. A count above 1 follows its remainder, less 1, as digits of a remainder's width,
    which the bits of `digits` mark. Both parts of every value are kept whole, so no two values are mixed.
    """
    quotient_bits = min(len(values).bit_length(), value_bits - 1)
    bits = value_bits - quotient_bits
    quotient = (values >> np.uint64(bits)).astype(np.int64)
    extra = (counts - 1).astype(np.uint64)
    digits = -(-np.frexp(extra.astype(np.float64))[1] // bits)
    before = np.cumsum(1 + digits) - (1 + digits)
    place = np.maximum.accumulate(quotient - before) + before
    last = place + digits
    slots = int(last[-1]) + 1
    content, is_digit = np.zeros(slots, np.uint64), np.zeros(slots, bool)
    content[place] = values & mask(bits)
    for d in range(int(digits.max())):
        at = np.flatnonzero(digits > d)
        content[place[at] + 1 + d] = (extra[at] >> np.uint64(d * bits)) & mask(bits)
        is_digit[place[at] + 1 + d] = True
    occupied, runends = np.zeros(1 << quotient_bits, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    runends[last[np.append(quotient[1:] != quotient[:-1], True)]] = True
    return {
        "quotient_bits": quotient_bits, "slots": slots, "occupied": np.packbits(occupied).tobytes(),
        "runends": np.packbits(runends).tobytes(), "digits": np.packbits(is_digit).tobytes(),
        "remainders": packed_bits(content, bits),
    }


def filter_items(stored: dict, value_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values of a filter and their counts."""
    bits, slots = value_bits - stored["quotient_bits"], stored["slots"]

    def flags(name, count):
        return np.unpackbits(np.frombuffer(stored[name], np.uint8), count=count).astype(bool)

    quotients = np.flatnonzero(flags("occupied", 1 << stored["quotient_bits"]))
    ends = np.flatnonzero(flags("runends", slots))
    starts = np.maximum(quotients, np.append(-1, ends[:-1]) + 1)
    lengths = ends - starts + 1
    first = np.cumsum(lengths) - lengths
    used = np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
    content, digit = unpacked_bits(stored["remainders"], bits, slots)[used], flags("digits", slots)[used]
    at = np.flatnonzero(~digit)
    values = (np.repeat(quotients, lengths)[at].astype(np.uint64) << np.uint64(bits)) | content[at]
    counts = np.ones(len(at), dtype=np.int64)
    item = np.cumsum(~digit) - 1
    where = np.flatnonzero(digit)
    shift = ((where - at[item[where]] - 1) * bits).astype(np.uint64)
    np.add.at(counts, item[where], (content[where] << shift).astype(np.int64))
    return values, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted items of several filters as one, counts of equal values added up."""
    if len(parts) == 1:
        return parts[0]
    values, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")  # merges runs that are in order already
    values, counts = values[order], counts[order]
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[at], np.add.reduceat(counts, at)


def shard_filters(shards: DataFrame, id_bits: int, bits: int) -> DataFrame:
    """For each shard and owner, the filter of the shard's phrases of two and three words."""
    h = half_bits(id_bits)

    def ngrams(words, fresh):
        none = np.zeros(0, np.uint64)
        if len(words) < 2:
            return none, none, none
        pair = (words[:-1] != 0) & (words[1:] != 0) & ~fresh[1:]
        three = pair[:-1] & pair[1:]
        first, second = np.flatnonzero(pair), np.flatnonzero(three)
        third = np.concatenate([np.zeros(len(first), np.uint64), words[second + 2]])
        both = np.concatenate([first, second])
        return words[both], words[both + 1], third

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), dtype="<u4")
                found = batch.column("found")[i].values
                ids = found_array(found, "id", batch.column("size")[i].as_py(), np.uint64)
                high, low, counts = counted(*permuted(*ngrams(ids[tokens >> 1], (tokens & 1) == 1), id_bits), h)
                owner = high >> np.uint64(h - bits)
                rest = ((high & mask(h - bits)) << np.uint64(h)) | low
                edges = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
                rows = [
                    {"owner": int(owner[s]), **filter_of(rest[s:e], counts[s:e], 2 * h - bits)}
                    for s, e in zip(edges, np.append(edges[1:], len(owner)))
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FILTER_ARROW)

    return shards.where(F.col("found").isNotNull()).select("tokens", "found", "size").mapInArrow(run, FILTERS)


FILTER_ARROW = pa.schema(
    [("owner", pa.int64()), ("quotient_bits", pa.int32()), ("slots", pa.int64())]
    + [(n, pa.binary()) for n in ("occupied", "runends", "digits", "remainders")]
)


def merged_counts(filters: DataFrame, id_bits: int, bits: int, minimum: int) -> DataFrame:
    """Phrases with at least `minimum` occurrences: w1, w2, w3 (0: none) and their count `a`.

    An owner's filters come as a stream and are merged whenever their items reach a fixed number, so a task
    holds the owner's different phrases and one more load.
    """
    h = half_bits(id_bits)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                parts.append(filter_items(row, 2 * h - bits))
                waiting += len(parts[-1][0])
                if waiting > MERGED_AT_ONCE:
                    parts, waiting = [merged(parts)], 0
        values, counts = merged(parts)
        often = counts >= minimum
        values, counts = values[often], counts[often]
        high = np.uint64(key[0].as_py()) << np.uint64(h - bits) | (values >> np.uint64(h))
        ids = restored(high, values & mask(h), id_bits)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(w.astype(np.int64)) for w in ids], pa.array(counts)], ["w1", "w2", "w3", "a"]
        )

    return filters.groupBy("owner").applyInArrow(merge, COUNTED)


def count_phrases(shards: DataFrame, words: DataFrame, minimum: int, per_owner: int = NGRAMS_PER_OWNER) -> DataFrame:
    """Counts of all phrases of two and three words that occur at least `minimum` times."""
    most = words.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    total = shards.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    id_bits = max(2, int(most).bit_length())
    bits = owner_bits(2 * total, id_bits, per_owner)
    known = checked(words.select("lang", "word", "id"))
    entries = shards.select("shard", "lang", F.posexplode("word").alias("pos", "word")).join(known, ["lang", "word"])
    narrow = shards.select("shard", "tokens", F.size("word").alias("size"))
    return merged_counts(shard_filters(regrouped(narrow, entries, ["id"]), id_bits, bits), id_bits, bits, minimum)


# Scores


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact to 38 digits."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    over = (whole[0] * whole[0]).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (whole[1] * whole[2]).cast("decimal(38,0)"))


def scored(counts: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one contains, with the counts l and r at their lowest-scoring cut.

    The parts of a candidate occur at least as often as it does, so they are candidates or words here too.
    """
    alone = words.select("id", F.col("f"))

    def joined(rows, key, name):
        side = alone.select(F.col("id").alias(key), F.col("f").alias(name))
        return rows.join(checked(side), key)

    pairs = counts.where("w3 = 0").drop("w3")
    threes = joined(joined(counts.where("w3 > 0"), "w1", "f1"), "w3", "f3")
    threes = threes.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
    threes = threes.join(
        pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"]
    )
    first, second = ratio(F.col("a"), F.col("f1"), F.col("f23")), ratio(F.col("a"), F.col("f12"), F.col("f3"))
    later = F.col("second") < F.col("first")
    threes = threes.withColumns({"first": first, "second": second}).select(
        "w1", "w2", "w3", "a",
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"),
        F.least("first", "second").alias("score"),
    )
    longer = counts.where("w3 > 0").select(
        F.inline(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")))
    )
    longest = longer.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    held = F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("a") * percent
    free = pairs.join(longest, ["w1", "w2"], "left").where(~held).drop("longer")
    twos = joined(joined(free, "w1", "l"), "w2", "r")
    return twos.select(
        "w1", "w2", F.lit(0).cast("long").alias("w3"), "a", "l", "r", ratio(F.col("a"), F.col("l"), F.col("r")).alias("score")
    ).unionByName(threes)


def collocations(
    docs: DataFrame,
    minimum: int = MINIMUM,
    percent: int = CONTAINED_PERCENT,
    reported: int = REPORTED,
    per_owner: int = NGRAMS_PER_OWNER,
) -> DataFrame:
    """The highest-scoring phrases of two or three words of each language.

    One row per reported phrase: lang, rank, phrase, a, l, r, n, score. Texts are lower-cased (A-Z), cut into
    pieces at `[.,;:!?\\x0A-\\x0D]` and into words between spaces and tabs; phrases lie within a piece. A
    candidate occurs at least `minimum` times; it is left out where a longer candidate around it occurs at
    least `percent` % as often. Everything is counted per language over all documents; `reported` is the
    length of the report.

    A null text has no words, a null lang counts as `und`; an empty text adds nothing and an empty table
    gives no rows. Repeated rows and equal doc_ids count as often as they occur, ties go by phrase. A very
    long text is cut between pieces into parts of 8 MB. Other columns are ignored.

    Documents are stored as shards of word numbers. Words that occur often enough get dense ids; packed
    phrases of ids are permuted and go to the owner named by their leading bits, one filter per shard and
    owner. The number of owners grows with the corpus.
    """
    shards = staged(word_shards(docs), "word-shards")
    words = vocabulary(shards, minimum)
    counts = staged(count_phrases(shards, words, minimum, per_owner), "phrases")
    totals = staged(shards.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    rows = scored(counts, words, percent)
    for at in ("w1", "w2", "w3"):
        name = words.select(F.col("id").alias(at), F.col("word").alias(f"{at}_word"), *["lang"][: at == "w1"])
        rows = rows.join(checked(name), at, "left" if at == "w3" else "inner")
    phrase = F.concat_ws(" ", "w1_word", "w2_word", "w3_word")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reported)
    return ranked.join(checked(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
